"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Quality rules drop what they reject; line dedup deletes later copies of
repeated runs of lines (a document left without a line goes); near-duplicates
(five-word shingles, similarity of 0.8 or more) keep one document of each
group; decontamination drops documents with a window of ten words of a
benchmark item; packing gives the token sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from folio.llm.shared import removed, shared_folder, working_folders
from folio.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the certified cutoffs keep, as they are."""
    ship(spark)
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of repeated runs of lines; those of which no line is left go."""
    ship(spark)
    return line_dedup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest doc_id; nulls and texts without words stay."""
    ship(spark)
    return minhash.keep_one(docs, shingle_words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item."""
    ship(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a token sequence."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``sf_dir``'s documents; each stage's result is a table in the shared folder.

    The working tables of a stage are deleted as soon as its result is written,
    and a stage's result when the next one's is.
    """
    ship(spark)
    folder, docs, last = shared_folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with working_folders(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            removed(spark, last)
        last = f"{folder}/{name}"
        docs = spark.read.parquet(last)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the tokenizer and the packing; the stages are tested against brute force.
ORACLE_SQL: str | None = None
