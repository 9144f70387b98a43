"""The way of PDF files through a run: tables first, a layout tool for prose, the class, page images for scans.

A file with tables takes its text from the page elements (fragments stitched,
pages merged, rows rebuilt); one without is given to the layout tool, whose
text counts where it is good enough; else the pages' own text stands. Scans
and files with a broken layout bring images of their first pages along.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import classify
from folio.operators.pdf_text import elements, rendered, routed
from folio.sources import pdf


class PdfTools(NamedTuple):
    """What reads PDF files, with the optional library as the default; each takes bytes and works on executors."""

    texts: Callable[[bytes, str | None], list[str]] = pdf.page_texts
    tables: Callable[[bytes, str | None], bool] = pdf.has_tables
    elements: Callable[[bytes, str | None], Iterator[dict]] = pdf.page_elements
    images: Callable[[bytes, str | None, int, int], list[bytes]] = pdf.page_images
    layout: Callable[[bytes], str] | None = None
    decrypt: Callable[[bytes, str], bytes] = pdf.decrypted


def unlocked(tools: PdfTools, content: bytes, password: str | None, folder: str | None, name: str, warn: Callable[[str], None]) -> tuple[bytes, str | None]:
    """A decrypted copy and no password; the file and its password where it can't be made. The copy is kept in ``folder``, where there is one."""
    if not password:
        return content, None
    try:
        plain = tools.decrypt(content, password)
    except Exception as e:  # noqa: BLE001 - missing library or wrong password: the reader may still open it
        warn(f"not decrypted: {type(e).__name__}")
        return content, password
    if folder:
        os.makedirs(folder, exist_ok=True)
        handle, path = tempfile.mkstemp(dir=folder)
        with os.fdopen(handle, "wb") as file:
            file.write(plain)
        os.replace(path, os.path.join(folder, name))
    return plain, None


def probed(files: DataFrame, tools: PdfTools, password: str | None = None, decrypt_dir: str | None = None) -> DataFrame:
    """(pos, text, pages, warnings, has_tables, layout) of PDF files (pos, filename, content): one pass; no failure ends it."""

    def one(name: str, content: bytes) -> tuple[str, int, list[str], bool, str]:
        warnings: list[str] = []
        content, key = unlocked(tools, content, password, decrypt_dir, name, warnings.append)
        try:
            pages = tools.texts(content, key)
        except ImportError:
            pages = []
            warnings.append("no PDF library on the executors; the file counts as a scan")
        except Exception as e:  # noqa: BLE001 - a broken file is a scan without text
            pages = []
            warnings.append(f"{type(e).__name__}: {e}")
        try:
            tables = bool(pages) and tools.tables(content, key)
        except Exception as e:  # noqa: BLE001 - then it goes the way of prose
            tables = False
            warnings.append(f"tables: {e}")
        layout = "" if tables else pdf.layout_text(tools.layout, content, warnings.append)
        return "".join(pages), max(1, len(pages)), warnings, tables, layout

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(n, c or b"") for n, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string())
            columns = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["pos", "text", "pages", "warnings", "has_tables", "layout"])

    return files.select("pos", "filename", "content").mapInArrow(run, "pos int, text string, pages int, warnings array<string>, has_tables boolean, layout string")


def with_images(files: DataFrame, tools: PdfTools, password: str | None, dpi: int, pages: int) -> DataFrame:
    """(pos, images) of PDF files (pos, content); none where they can't be made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                try:
                    own, key = unlocked(tools, content or b"", password, None, "", lambda _: None)
                    found = list(tools.images(own, key, dpi, pages))[:pages]
                except Exception:  # noqa: BLE001
                    found = []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found], pa.list_(pa.binary()))], ["pos", "images"])

    return files.select("pos", "content").mapInArrow(run, "pos int, images array<binary>")


def with_pdf_text(files: DataFrame, tools: PdfTools | None = None, *, password: str | None = None, decrypt_dir: str | None = None, dpi: int = 200, pages: int = 15) -> DataFrame:
    """``files`` (pos, filename, content, ...) without their content, with text, warnings, pdf_type and images."""
    own = tools or PdfTools()
    plain = probed(files, own, password, decrypt_dir)
    with_tables = files.join(plain.where("has_tables").select("pos"), "pos")

    def read(content: bytes, key: str | None) -> Iterator[dict]:
        return own.elements(*unlocked(own, content, key, None, "", lambda _: None))

    found = rendered(elements(with_tables, password=password, read=read))
    layout = plain.where("layout <> ''").select("pos", F.col("layout").alias("text"))
    text = routed(plain.select("pos", "text", "pages"), found, layout).select("pos", "text", F.col("type").alias("pdf_type"))
    scans = files.join(text.where(F.col("pdf_type").isin(classify.SCANNED, classify.BROKEN)).select("pos"), "pos")
    images = with_images(scans, own, password, dpi, pages)
    return files.drop("content").join(text, "pos").join(plain.select("pos", "warnings"), "pos").join(images, "pos", "left")
