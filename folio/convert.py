"""A conversion run: files in, Markdown or EPUB files and a row of results per file out."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import __version__
from folio.config import Config
from folio.functions import noise, pii, text
from folio.model.stage import Client, client_factory, settled, with_answers
from folio.operators.relations import actionable, free_names, run_summary, status_of
from folio.session import ship
from folio.sinks.epub import epub
from folio.sinks.writer import write_rows
from folio.sources.documents import with_text
from folio.sources.files import MAX_FILES, collect, read_files
from folio.sources.pdf_route import PdfTools, with_pdf_text

PUBLISHED = "2024-01-01 08:00+08:00"
FORMATS = ("md", "epub", "both")


def taken_names(spark: SparkSession, folders: Sequence[str], ext: str) -> DataFrame:
    """(folder, name) of the files with the primary extension that exist before the run."""
    rows = [(f, os.path.basename(p)[: -len(ext)]) for f in folders for p in glob.glob(os.path.join(glob.escape(f), f"*{ext}"))]
    return spark.createDataFrame(rows, "folder string, name string")


def convert(spark: SparkSession, paths: Sequence[str], *, output: str | Callable[[str], str], config: Config | None = None, output_format: str = "md", client: Callable[[], Client] | None = None, published: str = PUBLISHED, dry_run: bool = False, pdf: PdfTools | None = None) -> DataFrame:
    """Results: file, input, output, preview, status, error - in the order of ``paths`` by ``pos``.

    ``output`` is a folder or a function from a path to one. No file's failure
    ends the run. Texts are masked before a model sees them, its answer is
    masked, and so is the Markdown written. Transcripts are written as they
    are: neither a model nor masking touches them. ``pdf`` has the readers of
    PDF files; a scan's images go to the model with its text.
    """
    if output_format not in FORMATS:
        raise ValueError(f"unknown output format: {output_format}")
    ship(spark)
    own = config or Config(backend="none")
    factory = client or client_factory(own.backend, dict(own.model))
    folder_of = output if callable(output) else lambda _: output
    folders = spark.createDataFrame([(p, os.path.abspath(folder_of(p))) for p in dict.fromkeys(paths)], "plain string, folder string")
    files = read_files(spark, paths).withColumn("plain", F.regexp_replace("path", r"\Afile:/+", "/")).join(folders, "plain")
    primary = ".epub" if output_format == "epub" else ".md"
    named = free_names(files, taken_names(spark, sorted({os.path.abspath(folder_of(p)) for p in paths}), primary))
    named = named.withColumn("target", F.concat("folder", F.lit("/"), "name"))
    if dry_run:
        return named.select("pos", F.col("filename").alias("file"), F.col("plain").alias("input"), F.concat("target", F.lit(primary)).alias("output"), F.lit(None).cast("string").alias("preview"), F.lit("dry_run").alias("status"), F.lit(None).cast("string").alias("error"))
    is_pdf, is_transcript = F.col("ext") == ".pdf", F.col("ext") == ".jsonl"
    read = with_text(named.where(~is_pdf).drop("path"))
    if any(p.lower().endswith(".pdf") for p in paths):
        of_pdf = with_pdf_text(named.where(is_pdf).drop("path"), pdf, password=own.pdf_password, decrypt_dir=own.pdf_decrypt_dir, dpi=own.pdf_dpi, pages=own.pdf_max_pages)
        read = read.unionByName(of_pdf.drop("pdf_type"), allowMissingColumns=True)
    else:
        read = read.withColumn("images", F.lit(None).cast("array<binary>"))
    cleaned = noise.clean_text(F.col("text"), tails=own.tails, paragraphs=own.paragraphs, urls=own.urls)
    body = F.when(is_pdf, cleaned).otherwise(F.col("text"))
    if own.mask:
        body = F.when(is_transcript, body).otherwise(pii.redact(body, own.mask_names))
    read = read.withColumn("text", body)
    empty = (F.coalesce(F.length("text"), F.lit(0)) == 0) & (F.coalesce(F.size("images"), F.lit(0)) <= 0)
    if factory is not None:
        asked = with_answers(read.where(~is_transcript & ~empty), factory, own.prompt, images="images", retries=own.max_retries)
        done = settled(asked, names=own.mask_names, mask=own.mask)
        plain = read.where(is_transcript | empty)
        read = done.unionByName(plain, allowMissingColumns=True).drop("raw_answer")
        read = read.withColumn("warnings", F.when(F.col("model_error").isNotNull(), F.concat("warnings", F.array("model_error"))).otherwise(F.col("warnings"))).drop("model_error")
    else:
        kind = "struct<title: string, summary: string, refined_markdown: string, tags: array<string>, status: string>"
        read = read.withColumns({"answer": F.lit(None).cast(kind), "status": F.lit(None).cast("string")})
    read = read.withColumn("raw_status", F.when(empty, "no_content").otherwise(F.coalesce("status", F.lit("ok")))).drop("status")
    source = F.when(is_transcript, F.col("plain")).otherwise(F.col("filename"))
    stamp = published if own.frontmatter else None
    raw = text.raw_markdown(F.col("text"), F.col("filename"), source=source, published=stamp)
    refined = text.refined_markdown(F.col("answer.title"), F.col("answer.summary"), F.col("answer.refined_markdown"), F.col("answer.tags"), F.col("filename"), source=source, published=stamp)
    markdown = F.when(F.col("answer").isNull(), raw).otherwise(refined)
    if own.mask:
        markdown = F.when(is_transcript, markdown).otherwise(pii.redact(markdown, own.mask_names))
    wanted = F.col("raw_status") == "ok"
    written = read
    outputs = []
    if output_format in ("md", "both"):
        outputs.append((".md", F.encode(markdown, "utf-8")))
    if output_format in ("epub", "both"):
        has = F.col("answer").isNotNull()
        mask = (lambda c: pii.redact(c, own.mask_names)) if own.mask else (lambda c: c)
        title = F.when(has, mask(F.coalesce(F.nullif("answer.title", F.lit("")), F.col("filename")))).otherwise(F.col("filename"))
        content = F.when(has, F.coalesce("answer.refined_markdown", F.lit(""))).otherwise(F.col("text"))
        summary = F.when(has, F.coalesce("answer.summary", F.lit(""))).otherwise("Raw extraction")
        outputs.append((".epub", epub(title, content, summary=summary, tags=F.transform("answer.tags", mask), source=source, language=own.language)))
    for i, (ext, data) in enumerate(outputs):
        written = written.withColumns({f"output_{i}": F.when(wanted, F.concat("target", F.lit(ext))), "data": F.when(wanted, data)})
        written = write_rows(written, path=f"output_{i}").withColumnRenamed("write_error", f"error_{i}")
    failed = F.coalesce(*[F.col(f"error_{i}") for i in range(len(outputs))])
    written = written.withColumn("raw_status", F.when(failed.isNotNull(), "write_error").otherwise(F.col("raw_status")))
    written = written.withColumns({"status": status_of(F.col("raw_status")), "messages": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.filter(F.array(failed), lambda m: m.isNotNull()))})
    target = F.when(F.col("status") == "ok", F.col("output_0"))
    preview = target if output_format in ("md", "both") else F.lit(None).cast("string")
    return written.select("pos", F.col("filename").alias("file"), F.col("plain").alias("input"), target.alias("output"), preview.alias("preview"), "status", actionable(F.col("messages"), F.col("status")).alias("error"))


class Run(NamedTuple):
    """Results, the exit code, and whether the folder had more files than the limit."""

    results: DataFrame
    exit_code: int
    overflow: bool

    @property
    def summary(self) -> DataFrame:
        """The run's summary: one row with the counts and the exit code."""
        return run_summary(self.results, __version__)


def kept(df: DataFrame) -> DataFrame:
    """``df`` made once: a checkpoint in the shared folder where one is named, else in the cache (one machine)."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    context.setCheckpointDir(folder)
    return df.checkpoint()


def convert_folder(spark: SparkSession, path: str, *, recursive: bool = False, limit: int | None = MAX_FILES, **options) -> Run:
    """Results of the supported files at ``path``, made once. A tree is read up to ``limit`` files (None: all), told by ``overflow``."""
    found, overflow = collect(path, recursive=recursive, limit=limit)
    if not found:
        return Run(spark.createDataFrame([], "pos int, file string, input string, output string, preview string, status string, error string"), 2, overflow)
    results = kept(convert(spark, found, **options))
    return Run(results, run_summary(results, __version__).first()["exit_code"], overflow)
