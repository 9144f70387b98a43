"""Table repair on page elements: fragments of a page, tables across pages, collapsed rows, overlapping text.

Elements are rows (doc, page, seq, kind 'text' or 'table', y, y1, x0, x1,
header, rows, text). A document's elements are one group; the sequential rules
are folds over its sorted array, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import let

X_TOLERANCE, MAX_GAP, MAX_OVERLAP = 6.0, 30.0, 0.3
ELEMENT = "kind string, seq int, y double, y1 double, x0 double, x1 double, header array<string>, rows array<array<string>>, text string"
FIELDS = tuple(x.split()[0] for x in ELEMENT.split(", "))
STRUCT = f"struct<{', '.join(x.replace(' ', ': ', 1) for x in ELEMENT.split(', '))}>"


def element(e: Column, **changes: Column) -> Column:
    return F.struct(*[(changes.get(f, e[f])).alias(f) for f in FIELDS]).cast(STRUCT)


def with_last(out: Column, last: Column) -> Column:
    return F.concat(F.slice(out, 1, F.size(out) - 1), F.array(last))


def joins_fragment(head: Column, part: Column) -> Column:
    """A table of a header only continues the table before it: same columns, edges within tolerance, small gap, real geometry on both."""
    offset = F.greatest(F.abs(part["x0"] - head["x0"]), F.abs(part["x1"] - head["x1"]))
    return (
        (head["kind"] == "table") & (part["kind"] == "table") & (F.size(part["rows"]) == 0) & (F.size(part["header"]) == F.size(head["header"]))
        & (head["x1"] > 0) & (part["x1"] > 0) & (offset <= X_TOLERANCE) & (part["y"] - head["y1"] <= MAX_GAP)
    )


def stitched(parts: Column) -> Column:
    """A page's parts, sorted, with fragments joined to the table just before them; the head keeps its own edges."""

    def step(out: Column, part: Column) -> Column:
        def after(last: Column) -> Column:
            merged = element(last, rows=F.concat(last["rows"], F.array(part["header"])), y1=part["y1"])
            fits = F.coalesce(joins_fragment(last, part), F.lit(False))
            return F.when(fits, with_last(out, merged)).otherwise(F.concat(out, F.array(part)))

        return let(F.get(out, F.size(out) - 1), after)

    return F.aggregate(parts, F.array().cast(f"array<{STRUCT}>"), step)


def stitch_fragments(elements: DataFrame, *keys: str) -> DataFrame:
    """``elements`` with same-page fragments stitched, numbered anew by ``seq``; ``keys`` are the document and page columns.

    Parts are taken by (y, seq); nulls of y come first.
    """
    part = F.struct(*[F.col(f) for f in ("y", "seq", *[f for f in FIELDS if f not in ("y", "seq")])])
    grouped = elements.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ordered = F.transform("parts", lambda e: element(e))
    done = grouped.select(*keys, F.posexplode_outer(stitched(ordered)).alias("seq", "e")).where("e IS NOT NULL")  # posexplode took longer as measured: pdf_route over sf0.01 38 s, this 23
    return done.select(*keys, *[F.col("seq") if f == "seq" else F.col(f"e.{f}") for f in FIELDS])


def merged_pages(pages: Column) -> Column:
    """Parts of a document's pages in a row, tables that go on at the top of the next page joined.

    The first table of a page continues the last table of the page before
    where their headers are equal; equal rows altogether are one table, a
    first row equal to the last one before counts once. A page without a
    table ends the chain.
    """
    state = f"struct<out: array<{STRUCT}>, last: int>"

    def page(a: Column, parts: Column) -> Column:
        inner = f"struct<out: array<{STRUCT}>, own: int, before: int>"

        def step(b: Column, part: Column) -> Column:
            return let(F.get(b["out"], b["before"]), lambda target: after(b, part, target))

        def after(b: Column, part: Column, target: Column) -> Column:
            goes_on = F.coalesce((part["kind"] == "table") & (b["own"] < 0) & (b["before"] >= 0) & (part["header"] == target["header"]), F.lit(False))
            rows = F.when(part["rows"] == target["rows"], F.slice(part["rows"], 1, 0)).when(
                (F.size(part["rows"]) > 0) & (F.size(target["rows"]) > 0) & (F.get(part["rows"], F.lit(0)) == F.get(target["rows"], F.size(target["rows"]) - 1)), F.slice(part["rows"], 2, F.greatest(F.size(part["rows"]), F.lit(1)))
            ).otherwise(part["rows"])
            zero = F.lit(0.0)
            longer = element(target, rows=F.concat(target["rows"], rows), x0=zero, x1=zero, y1=zero)
            replaced = F.transform(b["out"], lambda e, i: F.when(i == b["before"], longer).otherwise(e))
            own = F.when(part["kind"] == "table", F.size(b["out"])).otherwise(b["own"])
            return F.when(goes_on, F.struct(replaced.alias("out"), b["before"].alias("own"), b["before"].alias("before"))).otherwise(F.struct(F.concat(b["out"], F.array(part)).alias("out"), own.alias("own"), b["before"].alias("before"))).cast(inner)

        start = F.struct(a["out"].alias("out"), F.lit(-1).alias("own"), a["last"].alias("before")).cast(inner)
        return F.aggregate(parts, start, step, lambda b: F.struct(b["out"].alias("out"), b["own"].alias("last")).cast(state))

    start = F.struct(F.array().cast(f"array<{STRUCT}>").alias("out"), F.lit(-1).alias("last")).cast(state)
    return F.aggregate(pages, start, page)["out"]


def merge_pages(elements: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """A document's elements in reading order with tables continued across pages joined."""
    part = F.struct(F.col("seq"), *[F.col(f) for f in FIELDS if f != "seq"])
    by_page = elements.groupBy(doc, page).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    pages = by_page.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "parts"))).alias("pages"))
    lists = F.transform("pages", lambda p: F.transform(p["parts"], lambda e: element(e)))
    done = pages.select(doc, F.posexplode_outer(merged_pages(lists)).alias("seq", "e")).where("e IS NOT NULL")  # posexplode took longer as measured: pdf_route over sf0.01 38 s, this 23
    return done.select(doc, *[F.col("seq") if f == "seq" else F.col(f"e.{f}") for f in FIELDS])


def column_of(center: Column, bounds: Column) -> Column:
    """Index of the first range ``[x0, x1)`` that holds ``center``, else of the nearest edge (the first of equals)."""
    inside = F.array_position(F.transform(bounds, lambda b: (b["x0"] <= center) & (center < b["x1"])), True) - 1
    distance = F.transform(bounds, lambda b, i: F.struct(F.least(F.abs(center - b["x0"]), F.abs(center - b["x1"])).alias("d"), i.alias("i")))
    return let(inside, lambda n: F.when(n >= 0, n).otherwise(F.array_min(distance)["i"])).cast("int")


def bucketed_words(words: Column, bounds: Column) -> Column:
    """One string per range of ``bounds``: its words by (y0, x0), joined with spaces."""
    ordered = F.array_sort(F.transform(words, lambda w, i: F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), i.alias("i"), column_of((w["x0"] + w["x1"]) / 2, bounds).alias("c"), w["text"].alias("text"))))
    return let(ordered, lambda o: F.transform(bounds, lambda b, i: F.array_join(F.transform(F.filter(o, lambda w: w["c"] == i), lambda w: w["text"]), " ")))


def rebuilt_rows(rows: Column, boxes: Column, words: Column) -> Column:
    """Rows of a table with those that collapsed into one cell taken apart by their words.

    ``boxes`` has each row's cell boxes (null for a cell that isn't there),
    ``words`` each row's words. The first row with the most boxes gives the
    column ranges, two at least; a row of at most one box is rebuilt where two
    or more ranges get words, at its full width with nulls elsewhere.
    """
    count = F.transform(boxes, lambda r, i: F.struct(F.size(F.filter(r, lambda b: b.isNotNull())).alias("n"), (-i).alias("i")))

    def with_ruler(ruler: Column) -> Column:
        bounds = F.filter(ruler, lambda b: b.isNotNull())
        place = F.transform(ruler, lambda b, i: F.size(F.filter(F.slice(ruler, 1, i + 1), lambda x: x.isNotNull())) - 1)
        return let(F.struct(bounds.alias("bounds"), place.alias("place")), lambda x: F.transform(rows, lambda r, i: row(r, i, ruler, x["bounds"], x["place"])))

    def row(r: Column, i: Column, ruler: Column, bounds: Column, place: Column) -> Column:
        def taken_apart(texts: Column) -> Column:
            full = F.transform(ruler, lambda b, k: F.when(b.isNotNull(), F.nullif(F.get(texts, F.get(place, k)), F.lit(""))))
            return F.when(F.size(F.filter(texts, lambda t: t != "")) >= 2, full).otherwise(r)

        collapsed = F.size(F.filter(F.get(boxes, i), lambda b: b.isNotNull())) <= 1
        return F.when(collapsed, let(bucketed_words(F.get(words, i), bounds), taken_apart)).otherwise(r)

    def with_best(best: Column) -> Column:
        sound = (F.size(rows) == F.size(boxes)) & (best["n"] >= 2)
        return F.when(F.coalesce(sound, F.lit(False)), let(F.get(boxes, -best["i"]), with_ruler)).otherwise(rows)

    return let(F.array_max(count), with_best)


def overlaps_any(box: Column, rectangles: Column, share: float = MAX_OVERLAP) -> Column:
    """Whether more than ``share`` of the box's area lies in one of the rectangles; a box without area doesn't."""
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])

    def common(r: Column) -> Column:
        wide = F.least(box["x1"], r["x1"]) - F.greatest(box["x0"], r["x0"])
        high = F.least(box["y1"], r["y1"]) - F.greatest(box["y0"], r["y0"])
        return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))

    return F.when(area > 0, F.exists(rectangles, lambda r: common(r) / area > share)).otherwise(False)


def outside_tables(blocks: DataFrame, tables: DataFrame, *keys: Sequence[str] | str) -> DataFrame:
    """Text blocks without those that overlap a table of their page: the page's rectangles as one array, no pairs of rows."""
    box = lambda: F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    rectangles = tables.groupBy(*keys).agg(F.collect_list(box()).alias("__folio_tables"))
    joined = blocks.join(rectangles, list(keys), "left")
    inside = F.coalesce(overlaps_any(box(), F.col("__folio_tables")), F.lit(False))
    return joined.where(~inside).drop("__folio_tables")
