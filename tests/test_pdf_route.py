import sys

import pytest
from pyspark import cloudpickle

from folio import config
from folio.convert import convert, convert_folder
from folio.sources.pdf_route import PdfTools

LONG = "a sentence of prose that is long enough to count as native text "


@pytest.fixture(autouse=True)
def by_value():
    """Workers can't import this module."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def texts(content, password):
    if content == b"broken":
        raise ValueError("no file")
    assert content != b"locked"
    return {b"scan": ["", ""], b"tables": [LONG * 5]}.get(content, [LONG * 5])


def elements(content, password):
    base = {"text": None, "boxes": None, "words": None, "x0": 34.5, "x1": 560.5}
    yield base | {"page": 1, "seq": 0, "kind": "text", "y": 0.0, "y1": 9.0, "header": None, "rows": None, "text": " intro "}
    yield base | {"page": 1, "seq": 1, "kind": "table", "y": 10.0, "y1": 30.0, "header": ["a", "b"], "rows": [["1", "2"]]}
    yield base | {"page": 2, "seq": 0, "kind": "table", "y": 10.0, "y1": 30.0, "header": ["a", "b"], "rows": [["3", "4"]]}


def images(content, password, dpi, pages):
    return [b"png%d" % i for i in range(40)] if content == b"scan" else []


def layout(content):
    return "" if content != b"prose" else "# Laid out<br>" + LONG * 5


def decrypt(content, password):
    if content != b"locked":
        raise ValueError("not encrypted")
    return b"prose"


TOOLS = PdfTools(texts, lambda c, p: c == b"tables", elements, images, layout, decrypt)


class Shown:
    """Answers with the number of images and signs."""

    def call(self, prompt, pictures, text):
        return '{"title": "t", "refined_markdown": "%d images"}' % len(pictures or [])


@pytest.fixture
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("tables", "prose", "scan", "broken", "own", "locked"):
        (folder / f"{name}.pdf").write_bytes(name.encode())
    (folder / "note.txt").write_text("a note")
    return folder


def test_routes_of_a_run(spark, source, tmp_path):
    out = tmp_path / "out"
    run = convert_folder(spark, str(source), output=str(out), pdf=TOOLS, config=config.Config(backend="none", frontmatter=False, pdf_password="p", pdf_decrypt_dir=str(tmp_path / "plain")))
    status = {r.file: r.status for r in run.results.collect()}
    assert status == {"tables.pdf": "ok", "prose.pdf": "ok", "scan.pdf": "ok", "broken.pdf": "skipped", "own.pdf": "ok", "locked.pdf": "ok", "note.txt": "ok"}
    read = lambda n: (out / f"{n}.md").read_text()
    assert "intro\n\n|a|b|\n|---|---|\n|1|2|\n|3|4|" in read("tables") and "Laid out" in read("prose") and "Laid out" in read("locked") and LONG.strip() in read("own")
    assert (tmp_path / "plain/locked.pdf").read_bytes() == b"prose"
    assert (run.exit_code, run.overflow) == (1, False) and run.summary.first()["total"] == 7


def test_images_go_to_the_model(spark, source, tmp_path):
    out = tmp_path / "out"
    results = convert(spark, [str(source / "scan.pdf"), str(source / "own.pdf")], output=str(out), pdf=TOOLS, client=Shown, config=config.Config(pdf_max_pages=3))
    assert {r.file: r.status for r in results.collect()} == {"scan.pdf": "ok", "own.pdf": "ok"}
    assert "3 images" in (out / "scan.md").read_text() and "0 images" in (out / "own.md").read_text()


def test_a_tree_tells_of_its_overflow(spark, tmp_path):
    for i in range(5):
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        (tmp_path / "in" / str(i) / "x.txt").write_text("x")
    runs = [convert_folder(spark, str(tmp_path / "in"), output=str(tmp_path / "out"), recursive=True, limit=n, dry_run=True) for n in (3, 5, None)]
    assert [(r.results.count(), r.overflow) for r in runs] == [(3, True), (5, False), (5, False)]


def test_without_the_library(spark, source, tmp_path):
    result = convert(spark, [str(source / "own.pdf")], output=str(tmp_path / "out")).first()
    assert result.status in ("skipped", "ok") and (result.status == "ok" or "PDF" in result.error)
