import sys

import pytest
from pyspark import cloudpickle

from folio.operators.pdf_text import elements, rendered, routed
from folio.sinks.preview import preview_file
from folio.sources import pdf


@pytest.fixture(autouse=True)
def by_value():
    """Workers can't import this module."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def fake(content, password):
    """Two pages: a paragraph, a table whose second row collapsed, a fragment; the table goes on."""
    if content == b"broken":
        raise ValueError("no file")
    base = {"text": None, "boxes": None, "words": None, "x0": 34.5, "x1": 560.5}
    cells = [{"x0": 0.0, "x1": 100.0}, {"x0": 100.0, "x1": 200.0}]
    words = [[], [{"x0": 10.0, "y0": 1.0, "x1": 20.0, "text": "left"}, {"x0": 120.0, "y0": 1.0, "x1": 130.0, "text": "right"}]]
    yield base | {"page": 1, "seq": 1, "kind": "text", "y": 0.0, "y1": 9.0, "header": None, "rows": None, "text": " intro "}
    yield base | {"page": 1, "seq": 0, "kind": "table", "y": 10.0, "y1": 30.0, "header": ["a", "b"], "rows": [["left right", None]], "boxes": [cells, [cells[0], None]], "words": words}
    yield base | {"page": 1, "seq": 2, "kind": "table", "y": 35.0, "y1": 45.0, "header": ["x|", "y"], "rows": [], "boxes": [cells], "words": [[]]}
    yield base | {"page": 2, "seq": 0, "kind": "table", "y": 10.0, "y1": 30.0, "header": ["a", "b"], "rows": [["x|", "y"], ["last", ""]]}


def test_tables_of_a_file(spark):
    files = spark.createDataFrame([(1, b"x"), (2, b"broken")], "pos int, content binary")
    got = rendered(elements(files, read=fake)).collect()
    assert [(r.pos, r.text) for r in got] == [(1, "intro\n\n|a|b|\n|---|---|\n|left|right|\n|x\\||y|\n|last| |")]


def test_routes(spark):
    plain = spark.createDataFrame([(1, "a native text that is long", 1), (2, "a native text that is long", 1), (3, "", 3), (4, "x", 1)], "pos int, text string, pages int")
    tables = spark.createDataFrame([(1, "table"), (3, "table")], "pos int, text string")
    layout = spark.createDataFrame([(1, "t" * 99), (2, "t<br>" * 30), (4, "short")], "pos int, text string")
    got = {r.pos: (r.text[:5], r.type, r.source) for r in routed(plain, tables, layout).collect()}
    assert got == {1: ("table", "native", "text"), 2: ("t t t", "native", "layout"), 3: ("", "scanned", "text"), 4: ("x", "scanned", "text")}
    assert {r.pos: r.source for r in routed(plain, tables).collect()}[2] == "text"


def test_without_the_library():
    said = []
    assert pdf.page_count(b"x") == 1 and pdf.has_tables(b"x") is False
    assert pdf.available() or pdf.pdf_text(b"x", said.append) == "" and said
    assert pdf.layout_text(None, b"x", said.append) == "" and pdf.layout_text(lambda _: 1 / 0, b"x", said.append) == ""


def test_preview_guard(tmp_path):
    path = tmp_path / "a.md"
    path.write_text("# T")
    assert preview_file(str(path)) == "<h1>T</h1>" and preview_file("a.md") is None and preview_file(str(tmp_path)) is None
