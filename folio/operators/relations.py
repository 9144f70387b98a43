"""Lookups, numbering, de-duplication and summaries: the relational operators of a conversion run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Status of a processed file as callers see it.
STATUS = {"ok": "ok", "dry_run": "dry_run", "no_content": "skipped", "write_error": "error", "error": "error"}


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """For each value of ``key`` its first row by ``order``: an aggregate that combines before the shuffle, so a hot value is one row a task."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("__folio_row"))
    return first.select(key, *[F.col(f"__folio_row.{c}").alias(c) for c in rest]).select(*df.columns)


def resolve_tools(results: DataFrame, tools: DataFrame, *, keys: list[str], name: str = "name", order: str = "seq", default: str = "tool") -> DataFrame:
    """Results with the name of their tool: the last one declared under their keys, ``default`` without any."""
    last = tools.groupBy(*keys).agg(F.max_by(name, order).alias("tool_name"))
    return results.join(last, keys, "left").withColumn("tool_name", F.coalesce("tool_name", F.lit(default)))


def numbered_spine(spine: DataFrame, manifest: DataFrame, nav: DataFrame, *, doc: str = "doc") -> DataFrame:
    """Linear items that aren't navigation, numbered in order, with their href; those without one keep their number but go."""
    linear = spine.where("linear").join(nav.select(doc, "idref").distinct(), [doc, "idref"], "left_anti")
    order = Window.partitionBy(doc).orderBy("pos")
    return linear.withColumn("chapter", F.row_number().over(order)).join(manifest.select(doc, "idref", "href"), [doc, "idref"])


def slide_files(tree: DataFrame, objects: DataFrame, *, doc: str = "doc") -> DataFrame:
    """Slides by their place in the tree, through the proxy's first reference; a proxy that leads nowhere leaves a gap."""
    references = objects.select(doc, F.col("object_id").alias("proxy_id"), F.get("references", F.lit(0)).alias("file_id")).where("file_id is not null")
    return tree.join(references, [doc, "proxy_id"]).select(doc, "slide", "file_id")


def status_of(raw: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, raw), F.lit("error"))


def free_names(files: DataFrame, taken: DataFrame | None = None, *, folder: str = "folder", stem: str = "stem", order: str = "pos") -> DataFrame:
    """``files`` with ``name``: the stem, or the first of stem_1, stem_2, ... that nothing has taken.

    ``taken`` (folder, name) are names that exist before. Within equal stems,
    files come by ``order``; each takes the next free suffix, so what matters
    of ``taken`` is its gaps: the k-th file gets the k-th free suffix. Stems
    that themselves look like ``x_1`` are taken for their owner first.
    """
    by_stem = Window.partitionBy(folder, stem).orderBy(order)
    ranked = files.withColumn("__folio_k", F.row_number().over(by_stem))
    own = files.select(F.col(folder).alias("f"), F.col(stem).alias("name")).distinct()
    blocked = own if taken is None else own.union(taken.select(F.col(folder).alias("f"), "name")).distinct()
    parts = F.regexp_extract("name", r"(?s)\A(.*)_([1-9][0-9]{0,8})\z", 1)
    number = F.regexp_extract("name", r"(?s)\A(.*)_([1-9][0-9]{0,8})\z", 2)
    suffixes = blocked.where(number != "").select(F.col("f").alias(folder), parts.alias(stem), number.cast("int").alias("n"))
    if taken is not None:  # a stem that exists already is suffix 0
        zero = taken.select(F.col(folder).alias(folder), F.col("name").alias(stem), F.lit(0).alias("n"))
        suffixes = suffixes.union(zero)
    gaps = suffixes.distinct().groupBy(folder, stem).agg(F.array_sort(F.collect_list("n")).alias("__folio_used"))
    used = F.coalesce("__folio_used", F.array().cast("array<int>"))
    # the k-th number from 0 that isn't among the used ones: every used number not above it moves it on
    place = F.aggregate(used, F.col("__folio_k") - 1, lambda k, n: F.when(n <= k, k + 1).otherwise(k))
    name = F.when(place == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), place.cast("string")))
    return ranked.join(gaps, [folder, stem], "left").withColumn("name", name).drop("__folio_k", "__folio_used")


def run_summary(results: DataFrame, version: str) -> DataFrame:
    """One row: version, total, success (ok or dry run), failed and the exit code 0, 1 or 2 (nothing to do)."""
    success = F.count_if(F.coalesce(F.col("status").isin("ok", "dry_run"), F.lit(False)))
    total = F.count(F.lit(1))
    code = F.when(total == 0, 2).when(success == total, 0).otherwise(1)
    return results.agg(F.lit(version).alias("version"), total.alias("total"), success.alias("success"), (total - success).alias("failed"), code.cast("int").alias("exit_code"))


def summary_json(results: DataFrame, version: str) -> DataFrame:
    """The summary as JSON with the files in order of input; for runs whose list of files fits a row."""
    files = F.transform(F.array_sort(F.collect_list(F.struct("pos", "file", "output", "status"))), lambda f: F.struct(f["file"].alias("file"), f["output"].alias("output"), f["status"].alias("status")))
    one = results.agg(files.alias("files")).crossJoin(run_summary(results, version))
    return one.select(F.to_json(F.struct("version", "total", "success", "failed", "files"), {"ignoreNullFields": "false"}).alias("summary"))


def actionable(messages: Column, status: Column) -> Column:
    """The error text of a file: for a skipped one the hint to export if any message gives it, else the last message."""
    hint = F.exists(messages, lambda m: F.lower(m).contains("export") | m.contains("匯出"))
    last = F.get(messages, F.size(messages) - 1)
    return F.when(status == "skipped", F.when(hint, F.element_at(F.filter(messages, lambda m: F.lower(m).contains("export") | m.contains("匯出")), 1)).otherwise(F.coalesce(last, F.lit("no extractable content")))).when(status == "error", F.coalesce(last, F.lit("processing failed")))


def within_budget(df: DataFrame, *, keys: list[str], order: list[str], size: Column, budget: int, base: Column | None = None) -> DataFrame:
    """Rows of each key whose running sum of ``size`` stays within ``budget``: a window, no search."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(size).over(running) + (base if base is not None else F.lit(0))
    return df.withColumn("__folio_used", total).where(F.col("__folio_used") <= budget).drop("__folio_used")


def per_group_limit(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__folio_n", number).where(F.col("__folio_n") <= limit).drop("__folio_n")
