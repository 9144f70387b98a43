import pytest
from pyspark.sql import functions as F

from folio.operators import layout

SCHEMA = f"doc string, page int, {layout.ELEMENT}"


def part(seq, y=0.0, kind="table", header=("h",), rows=(), x0=34.5, x1=560.5, y1=None, text=None, page=1):
    own = kind == "table"
    return ("d", page, kind, seq, y, y + 12.6 if y1 is None else y1, x0, x1, list(header) if own else None, [list(r) for r in rows] if own else None, text)


def stitched(spark, *parts):
    done = layout.stitch_fragments(spark.createDataFrame(list(parts), SCHEMA), "doc", "page").sort("seq").collect()
    return [(r.header, r.rows) if r.kind == "table" else r.text for r in done]


@pytest.mark.parametrize(
    ("change", "joins"),
    [({}, True), ({"y": 12.6 + 29}, True), ({"y": 12.6 + 31}, False), ({"x0": 39.5}, True), ({"x0": 41.5}, False), ({"x1": 0.0}, False), ({"rows": [["r"]]}, False), ({"header": ("a", "b")}, False), ({"y": 5.0}, True)],
)
def test_fragments(spark, change, joins):
    got = stitched(spark, part(0, 0.0, header=("a",)), part(1, **({"y": 20.0, "header": ("b",)} | change)))
    assert got[0] == (["a"], [["b"]]) if joins else len(got) == 2


def test_text_breaks_the_chain_and_drift_is_from_the_head(spark):
    assert len(stitched(spark, part(0), part(1, 13.0, "text", text="t"), part(2, 20.0))) == 3
    chain = [part(i, 20.0 * i, header=(str(i),), x0=34.5 + 4 * i) for i in range(3)]
    assert stitched(spark, *chain) == [(["0"], [["1"]]), (["2"], [])]


def merged(spark, *parts):
    done = layout.merge_pages(spark.createDataFrame(list(parts), SCHEMA)).sort("seq").collect()
    return [(r.header, r.rows) if r.kind == "table" else r.text for r in done]


def test_tables_across_pages(spark):
    first, second = part(0, rows=[["1"], ["2"]]), part(0, rows=[["2"], ["3"]], page=2)
    assert merged(spark, first, second) == [(["h"], [["1"], ["2"], ["3"]])]
    assert merged(spark, first, part(0, rows=[["1"], ["2"]], page=2)) == [(["h"], [["1"], ["2"]])]
    assert len(merged(spark, first, part(0, kind="text", text="x", page=2), part(0, rows=[["9"]], page=3))) == 3
    assert len(merged(spark, first, part(0, header=("i",), page=2))) == 2
    assert merged(spark, first, part(0, kind="text", text="x", page=2), part(1, rows=[["9"]], page=2)) == [(["h"], [["1"], ["2"], ["9"]]), "x"]


def test_columns_of_words(spark):
    bounds = F.array(*[F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1")) for a, b in ((0, 100), (100, 200), (200, 300))])
    words = [(10.0, 0.0, 20.0, "a"), (95.0, 0.0, 105.0, "edge"), (310.0, 0.0, 320.0, "far"), (5.0, 12.0, 15.0, "wrap"), (110.0, 0.0, 120.0, "b"), (-30.0, 0.0, -20.0, "left")]
    table = spark.createDataFrame([([*words],)], "w array<struct<x0: double, y0: double, x1: double, text: string>>")
    assert table.select(layout.bucketed_words(F.col("w"), bounds).alias("c")).first().c == ["left a wrap", "edge b", "far"]


def test_collapsed_rows(spark):
    box, word = "struct<x0: double, x1: double>", "struct<x0: double, y0: double, x1: double, text: string>"
    schema = f"rows array<array<string>>, boxes array<array<{box}>>, words array<array<{word}>>"
    ruler = [(0.0, 100.0), None, (100.0, 200.0)]
    rows = [["x", None, "y"], ["all in one", None, None], ["title", None, None]]
    words = [[], [(10.0, 0.0, 20.0, "l"), (150.0, 0.0, 160.0, "r")], [(10.0, 0.0, 20.0, "title")]]
    table = spark.createDataFrame([(rows, [ruler, [(0.0, 200.0), None, None], [(0.0, 200.0), None, None]], words)], schema)
    rebuilt = layout.rebuilt_rows(F.col("rows"), F.col("boxes"), F.col("words"))
    assert table.select(rebuilt.alias("r")).first().r == [["x", None, "y"], ["l", None, "r"], ["title", None, None]]


def test_overlaps(spark):
    blocks = spark.createDataFrame([(1, "in", 0.0, 10.0, 0.0, 10.0), (1, "edge", 7.0, 17.0, 0.0, 10.0), (1, "flat", 0.0, 10.0, 0.0, 0.0), (2, "other page", 0.0, 10.0, 0.0, 10.0)], "page int, t string, x0 double, x1 double, y0 double, y1 double")
    tables = spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0)], "page int, x0 double, x1 double, y0 double, y1 double")
    assert sorted(r.t for r in layout.outside_tables(blocks, tables, "page").collect()) == ["edge", "flat", "other page"]


def test_words_of_a_row_are_bucketed_once(spark):
    """F2 of r03: the expression stood in the lambda at every use and was evaluated again for each column."""
    rebuilt = str(layout.rebuilt_rows(F.col("rows"), F.col("boxes"), F.col("words"))._jc)
    assert rebuilt.count("array_sort") == 1


def test_let_evaluates_once(spark):
    """F2 of r03: what a lambda uses several times is bound, so columns of a wide table don't multiply the work."""
    from folio.functions.text import let

    drawn = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: let(F.rand() + i, lambda x: x == x))
    assert all(spark.range(1).select(drawn.alias("d")).first().d)
