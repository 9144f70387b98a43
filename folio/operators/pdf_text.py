"""Text of PDF files with their tables, from page elements: rows rebuilt, fragments stitched, pages merged, then rendered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import classify
from folio.functions.tables import compact_table
from folio.functions.text import trim_ws
from folio.operators.layout import FIELDS, merge_pages, rebuilt_rows, stitch_fragments

BOX, WORD = "struct<x0: double, x1: double>", "struct<x0: double, y0: double, x1: double, text: string>"
ELEMENTS = f"page int, seq int, kind string, y double, y1 double, x0 double, x1 double, header array<string>, rows array<array<string>>, boxes array<array<{BOX}>>, words array<array<{WORD}>>, text string"


def elements(files: DataFrame, *, key: str = "pos", password: str | None = None, read: Callable[[bytes, str | None], Iterator[dict]] | None = None) -> DataFrame:
    """Rows of ``ELEMENTS`` of each file (key, content), one pass over its pages; a file that can't be read has none."""
    from folio.sources.pdf import page_elements

    reader = read or page_elements
    box, word = pa.struct([("x0", pa.float64()), ("x1", pa.float64())]), pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("text", pa.string())])
    strings, number = pa.list_(pa.string()), pa.float64()
    types = {"page": pa.int32(), "seq": pa.int32(), "kind": pa.string(), "y": number, "y1": number, "x0": number, "x1": number, "header": strings, "rows": pa.list_(strings), "boxes": pa.list_(pa.list_(box)), "words": pa.list_(pa.list_(word)), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(reader(content, password))
                except Exception:  # noqa: BLE001 - missing library, broken or locked file: it counts as a scan
                    found = []
                if found:
                    keys = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array([e[n] for e in found], t) for n, t in types.items())], [key, *types])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, {ELEMENTS}")


def rendered(found: DataFrame, key: str = "pos") -> DataFrame:
    """(key, text): the elements in reading order, tables as pipe tables, blank lines between."""
    whole = F.concat(F.array("header"), "rows")
    full = F.when(F.col("kind") == "table", rebuilt_rows(whole, F.col("boxes"), F.col("words")))
    sound = F.size("boxes") == F.size("rows") + 1
    repaired = found.withColumn("__all", F.when(F.coalesce(sound, F.lit(False)), full))
    repaired = repaired.withColumn("rows", F.when(F.col("__all").isNotNull(), F.slice("__all", 2, F.greatest(F.size("__all"), F.lit(1)))).otherwise(F.col("rows")))
    pages = stitch_fragments(repaired.select(key, "page", *FIELDS), key, "page")
    merged = merge_pages(pages, key, "page")
    text: Column = F.when(F.col("kind") == "table", compact_table(F.col("rows"), F.col("header"))).otherwise(trim_ws(F.col("text")))
    parts = merged.select(key, "seq", text.alias("t"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("seq", "t"))))  # a filter would make the texts twice
    return parts.groupBy(key).agg(ordered.alias("p")).where(F.size("p") > 0).select(key, F.array_join(F.transform("p", lambda p: p["t"]), "\n\n").alias("text"))


def routed(plain: DataFrame, tables: DataFrame, layout: DataFrame | None = None, *, key: str = "pos") -> DataFrame:
    """The text to use and its class: a layout tool's where it is good enough and no table was found, else the pages' own, with tables unless it is a scan.

    ``plain`` has (key, text, pages), ``tables`` the rendered elements of the
    files with tables, ``layout`` (key, text) of a layout tool.
    """
    own = plain.join(tables.withColumnRenamed("text", "__tables"), key, "left")
    own = own.join(layout.withColumnRenamed("text", "__layout"), key, "left") if layout is not None else own.withColumn("__layout", F.lit(None).cast("string"))
    tool = classify.clean_layout(F.col("__layout"))
    accepted = F.col("__tables").isNull() & F.coalesce(classify.accepts_layout(tool, F.col("pages")), F.lit(False))
    kind = F.when(accepted, classify.NATIVE).otherwise(classify.classify(F.col("text"), F.col("pages"))["type"])
    text = F.when(accepted, tool).when(kind != classify.SCANNED, F.coalesce("__tables", "text")).otherwise(F.col("text"))
    return own.select(key, text.alias("text"), kind.alias("type"), F.when(accepted, "layout").otherwise("text").alias("source"))
