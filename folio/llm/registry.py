"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, html_text, line_dedup, lm_score, minhash, packing, quality_rules, token_counts, url_rules, warc
from folio.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).drop("longest_match")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clusters(table(spark, sf_dir, "documents"), shingle_words=2)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1,
    "op2_url_rules": op2,
    "op3_quality_rules": op3,
    "op4_line_dedup": op4,
    "op5_token_counts": op5,
    "op6_html_text": op6,
    "op7_minhash": op7,
    "op8_best_fit_packing": op8,
    "op9_lm_scores": op9,
    "op10_warc": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.REPORT_SQL,
    "op2_url_rules": url_rules.JUDGE_SQL,
    "op3_quality_rules": quality_rules.JUDGE_SQL,
    "op10_warc": warc.ROUND_TRIP_SQL,
}
