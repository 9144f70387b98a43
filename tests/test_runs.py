import json

import pytest
from pyspark.sql import functions as F

from folio import config
from folio.convert import convert, convert_folder
from folio.functions.markup import split_row, to_html, to_xhtml
from folio.functions.urls import checked_local_url, checked_url, refusal
from folio.model import stage
from folio.model.repair import answer, repair
from folio.operators import relations
from folio.sinks.epub import book
from folio.sources.archives import epub


@pytest.mark.parametrize("url", ["http://127.0.0.1", "http://localhost:8000/v1", "http://LOCALHOST", "http://10.1.2.3", "http://192.168.0.1", "http://169.254.169.254", "http://0.0.0.0", "http://[::1]", "http://[fe80::1]", "http://[::ffff:192.168.1.1]", "http://224.0.0.1", "http://2130706433", "http://0x7f000001", "http://127.1", "http://127%2E0%2E0%2E1", "http://", "ftp://example.com", "file:///etc", "", None])
def test_refused_addresses(url):
    assert refusal(url)


def test_allowed_addresses():
    assert checked_url("https://api.example.com/v1/") == "https://api.example.com/v1" and refusal("http://8.8.8.8") is None
    assert checked_local_url("http://localhost:11434")
    with pytest.raises(ValueError):
        checked_local_url("http://example.com")


def test_markup():
    assert split_row(r"| a \| b | c\\ |") == ["a | b", "c\\"] and split_row("") == []
    assert to_html("<script>x</script> [a](javascript:x) [b](https://c.d)") == '<p>&lt;script&gt;x&lt;/script&gt; [a](javascript:x) <a href="https://c.d">b</a></p>'
    assert to_html("a\nb\n\n> q\n> r\n---\n1. x\n2. y") == "<p>a b</p>\n<blockquote>q r</blockquote>\n<hr>\n<ol><li>x</li><li>y</li></ol>"
    assert to_xhtml("## H\n- a\n1. b\n|x|\n```\n<") == "<h2>H</h2>\n<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n</ol>\n<table>\n<tbody>\n<tr>\n<td>x</td>\n</tr>\n</tbody>\n</table>\n<pre><code>\n&lt;"
    assert to_html("") == ""


def test_books_are_read_again():
    content = book("A & B", "# One\n\ntext\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "about", ["t"])
    assert content == book("A & B", "# One\n\ntext\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "about", ["t"])
    assert content[30:38] == b"mimetype" and epub(content, print).startswith("# A & B\n作者：folio\n\n## A & B\n\nabout\n\nt\n\nOne\n\ntext\n\na\n\nb\n\n1\n\n2")


@pytest.mark.parametrize(("raw", "expected"), [('{"title": "x"}', {"title": "x"}), ('```json\n{"title": "x",}\n```', {"title": "x"}), ('{"title": "x", "tags": ["a"', {"title": "x", "tags": ["a"]}), ('{"title": "x', {"title": "x"})])
def test_repair(raw, expected):
    assert repair(raw) == expected


def test_answers(spark):
    raws = ['{"title": "x", "tags": ["a", 1]}', '{"refined_markdown": "a\\nb" oops', "plain", "[1]", None, '{"title": 5}']
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", answer(F.col("raw")).alias("a")).sort("i").collect()
    assert rows[0].a.title == "x" and rows[1].a.refined_markdown == "a\nb" and rows[1].a.status == "partial_recovery"
    assert rows[2].a.refined_markdown == "plain" and rows[3].a.status == "error" and (rows[4].a is None or rows[4].a.title is None)


def fake():
    """A class that is sent to workers by value."""

    class Fake:
        def __init__(self):
            self.calls = 0

        def call(self, prompt, images, text):
            self.calls += 1
            if "fail once" in text and self.calls == 1:
                raise TimeoutError("slow")
            if "fail" in text and "once" not in text:
                raise RuntimeError("down")
            if "garbage" in text:
                return "no json"
            return json.dumps({"title": "T", "summary": "call 12345678", "refined_markdown": f"saw {text}", "tags": ["t"]})

    return Fake


Fake = fake()


def test_retries():
    waits = []
    assert stage.ask(Fake(), "p", None, "fail once", 1, waits.append)[0] and waits == [1.0]
    assert stage.ask(Fake(), "p", None, "fail", 2, waits.append) == (None, "RuntimeError: down") and waits == [1.0, 1.0, 2.0]
    with pytest.raises(stage.ConfigError):
        stage.client_factory("openai")
    with pytest.raises(stage.ConfigError):
        stage.client_factory("gemini", environment={})
    assert stage.client_factory("none") is None and stage.client_factory("ollama")


def test_runs(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    out.mkdir()
    (out / "a.md").write_text("there before")
    (source / "a.txt").write_text("text 12345678")
    (source / "a.md").write_text("second")
    (source / "bad.docx").write_bytes(b"broken")
    (source / "t.jsonl").write_text(json.dumps({"type": "user", "sessionId": "s", "message": {"content": "id 12345678"}}))
    settings = config.Config(backend="none", mask=True, frontmatter=False)
    results, code, more = convert_folder(spark, str(source), output=str(out), config=settings, output_format="both")
    assert not more
    rows = {r.file: r for r in results.sort("pos").collect()}
    assert code == 1 and rows["bad.docx"].status == "skipped" and rows["bad.docx"].error
    assert (out / "a_1.md").read_text() == "# a.md\n\nsecond\n" and (out / "a_2.md").read_text() == "# a.txt\n\ntext 1234****\n"
    assert "12345678" in (out / "t.md").read_text() and (out / "a_2.epub").exists()
    assert rows["a.txt"].preview == rows["a.txt"].output == str(out / "a_2.md")
    assert convert_folder(spark, str(tmp_path / "none"), output=str(out)).exit_code == 2
    dry = convert(spark, [str(source / "a.txt")], output=str(out), config=settings, dry_run=True).first()
    assert dry.status == "dry_run" and dry.output.endswith("a_3.md")


def test_runs_with_a_model(spark, tmp_path):
    for name, text in (("x.txt", "hello 87654321"), ("y.txt", "garbage"), ("z.txt", "fail")):
        (tmp_path / name).write_text(text)
    settings = config.Config(backend="none", mask=True, frontmatter=False, max_retries=0)
    results = convert(spark, [str(tmp_path / n) for n in ("x.txt", "y.txt", "z.txt")], output=lambda p: str(tmp_path / "o"), config=settings, client=Fake)
    assert [r.status for r in results.sort("pos").collect()] == ["ok"] * 3
    assert (tmp_path / "o/x.md").read_text() == "# T\n\n> call 1234****\n\nsaw hello 8765****\n"
    assert (tmp_path / "o/y.md").read_text() == "# y.txt\n\ngarbage\n" and (tmp_path / "o/z.md").read_text() == "# z.txt\n\nfail\n"


def test_names_and_summaries(spark):
    files = spark.createDataFrame([("d", "a", 1), ("d", "a", 2), ("d", "a_1", 3), ("d", "b", 4)], "folder string, stem string, pos int")
    taken = spark.createDataFrame([("d", "a"), ("d", "a_3")], "folder string, name string")
    assert [r.name for r in relations.free_names(files, taken).sort("pos").collect()] == ["a_2", "a_4", "a_1", "b"]
    results = spark.createDataFrame([(1, "f", "o", "ok"), (2, "g", None, "error")], "pos int, file string, output string, status string")
    assert json.loads(relations.summary_json(results, "1").first().summary) == {"version": "1", "total": 2, "success": 1, "failed": 1, "files": [{"file": "f", "output": "o", "status": "ok"}, {"file": "g", "output": None, "status": "error"}]}
    assert relations.run_summary(results.limit(0), "1").first().exit_code == 2


def test_slides(spark):
    tree = spark.createDataFrame([("d", 1, "p1"), ("d", 2, "gone"), ("d", 3, "p3")], "doc string, slide int, proxy_id string")
    objects = spark.createDataFrame([("d", "p1", ["f9", "x"]), ("d", "p3", ["f2"])], "doc string, object_id string, references array<string>")
    assert sorted((r.slide, r.file_id) for r in relations.slide_files(tree, objects).collect()) == [(1, "f9"), (3, "f2")]


def test_config(spark, tmp_path):
    path = tmp_path / "c.json"
    (tmp_path / "p.txt").write_text("my prompt")
    path.write_text(json.dumps({"ai": {"backend": "groq", "prompt_template": "p.txt", "groq": {"api_key": "k"}}, "pdf": {"password": "file"}, "pii": {"enabled": True}, "ad_truncation_patterns": []}))
    own = config.load(str(path), spark=spark, environment={"PDF_PASSWORD": "env"})
    assert (own.backend, own.prompt, own.pdf_password, own.mask, own.tails) == ("groq", "my prompt", "file", True, None)
    assert config.load(None, password="x", environment={}).pdf_password == "x" and config.leaked_secrets(json.loads(path.read_text())) == ["GROQ_API_KEY", "PDF_PASSWORD"]
    with pytest.raises(config.ConfigError):
        config.check_patterns(spark, {"ad_strip_patterns": ["("]})
    with pytest.raises(config.ConfigError):
        config.load(None, password="x" * 1025)
    path.write_text('{"output_mode": ["x"], "lang": "en", "output_format": "both"}')
    assert config.user_settings(str(path)) == {"version": 1, "output_mode": "sibling", "custom_output_dir": None, "last_input_dir": None, "output_format": "both", "lang": "en"}
    assert config.version_of('[a.b]\nversion = "1.2"', "a", "b", "version") == "1.2" and config.version_of("= broken\nversion = \"3\"") == "3" and config.version_of("") == "unknown"
    assert config.interface_language("zh_TW") == "zh" and config.interface_language(None) == "en"


def test_streams(spark, tmp_path):
    from folio.streaming import documents as d

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("see http://x.y and 12345678")
    d.to_table(d.profiled(d.file_stream(spark, str(tmp_path / "in"))).select("filename", "redacted", "pii.total"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row.filename, row.redacted, row.total) == ("a.txt", "see  and 1234****", 1)


def test_sql_functions(spark):
    from folio.sql import register

    assert "folio_redact" in register(spark)
    row = spark.sql("select folio_redact('A123456789') a, folio_escape_cell(' x | y\\\\ ') b, folio_trim('　x ') c, folio_strip_urls('a http://b c') d, folio_url_allowed('http://127.1') e, folio_has_pipe_table('|a|b|') f, folio_truncate_tail('abc 謹慎理財信用至上') g").first()
    assert tuple(row) == ("A1234****", "x \\| y\\\\", "x", "a  c", False, True, "abc 謹慎理財信用至上") or row.g == "abc"


def test_driver_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
