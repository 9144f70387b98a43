import pytest
from pyspark.sql import functions as F

from folio.functions import classify, noise, pii, tables, text
from folio.functions.pii import with_redaction


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "expected"), [(None, ""), ("", ""), ("  a\t\nb　c ", "a b c"), ("a|b", "a\\|b"), ("a\\", "a\\\\"), ("a\\|b", "a\\\\\\|b")])
def test_escape_cell(spark, value, expected):
    assert one(spark, value, text.escape_cell) == expected


@pytest.mark.parametrize(
    ("value", "expected", "count"),
    [
        ("card 4321-1234-5678-9012.", "card 4321-****-****-9012.", 1), ("4321 1234 5678 9012", "4321-****-****-9012", 1), ("A123456789", "A1234****", 1), ("a123456789 A323456789", "a123456789 A323456789", 0),
        ("0912345678, 0912-345-678", "0912-***-***, 0912-***-***", 2), ("02-1234-5678 or 049-123-4567", "02-****-**** or 049-****-****", 2), ("0212345678", "0212345678", 0), ("12345678", "1234****", 1), ("123456789", "123456789", 0),
        ("電話0912345678", "電話0912345678", 0), ("統編:12345678號", "統編:1234****號", 1), ("１２３４５６７８", "１２３４****", 1), ("", "", 0), (None, None, 0), ("😀 12345678 😀 87654321", "😀 1234**** 😀 8765****", 2),
    ],
)
def test_redaction(spark, value, expected, count):
    assert one(spark, value, pii.redact) == expected
    row = with_redaction(spark.createDataFrame([(value,)], "t string"), "t", redacted="r", counts="c").first()
    assert (row.r, row.c["total"] or 0) == (expected, count)


def test_redaction_of_some_kinds(spark):
    assert one(spark, "12345678 A123456789", lambda c: pii.redact(c, {"national_id"})) == "12345678 A1234****"


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("body " * 20 + "依金融監督管理委員會保險局 tail", ("body " * 20).rstrip()), ("依金融監督管理委員會保險局 tail", "依金融監督管理委員會保險局 tail"), ("a" * 30 + "謹慎理財" + "x" * 70, "a" * 30 + "謹慎理財" + "x" * 70),
        ("a" * 3 + "謹慎理財信用至上" + "x" * 7, "a" * 3 + "謹慎理財信用至上" + "x" * 7), ("a" * 6 + " 謹慎理財信用至上", "a" * 6), ("see http://a.b/c?d now", "see  now"), ("x\n\n\n\n\ny\n", "x\n\ny"), ("mma.tw/abc", ""), ("", ""),
    ],
)
def test_clean_text(spark, value, expected):
    assert one(spark, value, noise.clean_text) == expected


def test_keep_ratio_at_its_edge(spark):
    tail = "謹慎理財信用至上"
    kept = lambda n: one(spark, "a" * n + tail + "b" * (1000 - n - len(tail)), noise.truncate_tail)
    assert kept(300) == "a" * 300 and len(kept(299)) == 1000


def test_strip_paragraphs(spark):
    strip = lambda value, *p: one(spark, value, lambda c: noise.strip_paragraphs(c, p))
    assert strip("a AD x\ny\n\nb AD\n\nc", "AD") == "a \n\nb \n\nc"
    assert strip("keep\n\nAD to the end", r"(?P<x>A)D") == "keep\n\n"
    assert noise.java_pattern(r"(?P<n>a)(?P=n)\Z") == r"(?U)(?<n>a)\k<n>\z"


def test_classes_at_their_edges(spark):
    kind = lambda value, pages=1: one(spark, value, lambda c: classify.classify(c, F.lit(pages)))
    assert kind("x" * 8).type == classify.BROKEN and kind("x" * 7).type == classify.SCANNED
    assert kind("x" * 95 + "�" * 5).type == classify.SCANNED and kind("x" * 96 + "�" * 4).type == classify.NATIVE
    lines = lambda short: "\n".join(["short"] * short + ["a line that is long"] * (100 - short))
    assert kind(lines(70)).type == classify.NATIVE and kind(lines(71)).type == classify.BROKEN
    assert kind("", 0).page_count == 1 and kind(None).type == classify.SCANNED and kind(None).char_density is None
    assert kind("x" * 100, 3).char_density == 33.3


def test_layout_rules(spark):
    assert one(spark, "x" * 49, lambda c: classify.accepts_layout(c, F.lit(1))) is False
    assert one(spark, "x" * 50, lambda c: classify.accepts_layout(c, F.lit(3))) is False
    assert one(spark, "|a|b|" + "x" * 50, lambda c: classify.accepts_layout(c, F.lit(9))) is True
    assert one(spark, "a<br/>b\n![image 1](x.png)\n\n\nc", classify.clean_layout) == "a b\n\nc"


ROWS = "array<array<string>>"


@pytest.mark.parametrize(
    ("style", "rows", "expected"),
    [
        (tables.compact_table, [["a", None], ["b|c", "x\ny"], ["d"]], "|a| |\n|---|---|\n|b\\|c|x y|\n|d| |"), (tables.compact_table, [["", " "]], ""), (tables.compact_table, [], ""), (tables.compact_table, [[]], ""),
        (tables.document_table, [["1", "-2"], ["a", "b", "c"]], "|  |  |  |\n| --- | --- | --- |\n| 1 | -2 |  |\n| a | b | c |"), (tables.document_table, [["h", "2"], ["a", ""]], "| h | 2 |\n| --- | --- |\n| a |  |"),
        (tables.slide_table, [["h"], ["a", "b"]], "| h |\n| --- |\n| a | b |"), (tables.slide_table, [], ""), (tables.sheet_table, [["h", "i"], ["a"], ["b", "c", "d"]], "| h | i |\n| --- | --- |\n| a |  |\n| b | c |"),
    ],
)
def test_tables(spark, style, rows, expected):
    assert one(spark, rows, style, ROWS) == expected


def test_external_header(spark):
    assert one(spark, [["1"]], lambda c: tables.compact_table(c, F.array(F.lit("h"), F.lit("i"))), ROWS) == "|h|i|\n|---|---|\n|1| |"
    assert one(spark, [["1"]], lambda c: tables.compact_table(c, F.array().cast("array<string>")), ROWS) == "|1|\n|---|"


def test_budgeted_sheet(spark):
    from folio.sources.archives import numbers_table

    for n in (0, 1, 5, 40):
        rows = [["h1", "h2"], *[[f"a{i}", "x" * (i % 9)] for i in range(n)]]
        for budget in (5, 30, 60, 200, 8000):
            assert one(spark, rows, lambda c, b=budget: tables.budgeted_sheet(c, b), ROWS).markdown == numbers_table(rows, budget)


def test_frames(spark):
    got = one(spark, 'a "b"\\\n', lambda c: text.frontmatter(c, F.lit("d"), F.array(F.lit("t")), F.lit(None).cast("string"), "now"))
    assert got == '---\ntitle: "a \\"b\\"\\\\\\n"\ndescription: "d"\npubDate: "now"\ndraft: true\ntags:\n  - "t"\nsourcePath: ""\n---\n'
    assert "tags: []" in one(spark, "x", lambda c: text.raw_markdown(c, F.lit("f.txt"), published="now"))
    assert one(spark, "x", lambda c: text.raw_markdown(c, F.lit("f.txt"))) == "# f.txt\n\nx\n"
    assert one(spark, "---\ntitle: \"T\"\n---\nbody", text.title_from_frontmatter) == "T"
    assert one(spark, "---\ntitle: x\nno end", text.body_after_frontmatter) == "---\ntitle: x\nno end"
    assert one(spark, "a\x00<b>&\"\x0b￾", text.xml_escape) == "a&lt;b&gt;&amp;&quot;"
    assert one(spark, " " + "x" * 61, text.truncate) == "x" * 60 + "…"


def test_refined_markdown_of_empty_texts_equals_its_sql(spark, tmp_path):
    """F4 of r03: the query left empty texts and their summaries out, its SQL doesn't."""
    import duckdb

    from folio.plans.catalogue import ORACLE_SQL, QUERIES

    rows = [(1, "a", "en", "s"), (2, "b" * 60, "en", "s"), (3, "", "en", "s"), (4, "", "en", "s"), (5, None, "en", "s"), (6, None, "en", "s"), (7, "c", None, None), (8, " ", None, "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = dict(connection.execute(ORACLE_SQL["refined_markdown"]).fetchall())
    assert {r.doc_id: r.markdown for r in QUERIES["refined_markdown"](spark, str(tmp_path)).collect()} == expected
    answer = text.refined_markdown(F.lit("t"), F.lit(""), F.lit(""), F.array(), F.lit("f"))
    assert spark.range(1).select(answer.alias("m")).first().m == "# t\n\n"
