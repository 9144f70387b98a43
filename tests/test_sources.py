import io
import json
import zipfile

import pytest

from folio.sources import archives as a
from folio.sources.documents import read_one
from folio.sources.files import collect, distinct_paths, read_files, read_folder


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries.items():
            archive.writestr(name, data)
    return out.getvalue()


def ignore(_):
    pass


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    return packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def test_docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, span="": f"<w:tc><w:tcPr>{span}</w:tcPr>{p(t)}</w:tc>"
    wide = '<w:gridSpan w:val="2"/>'
    table = f"<w:tbl><w:tr>{cell('a|b')}{cell('c', wide)}</w:tr><w:tr>{cell('x')}<w:tc><w:p><w:r><w:t>l</w:t><w:br/><w:t>m</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    assert a.docx(docx(p("one") + p(" ") + table), ignore) == "one\n\n| a\\|b | c |  |\n| --- | --- | --- |\n| x | l m |  |"
    assert read_one(".docx", b"no zip")[0] == "" and "BadZipFile" in read_one(".DOCX", b"no zip")[1][0]


def test_zip_bombs_and_entities():
    with pytest.raises(a.Rejected):
        a.open_zip(packed({"x": "y" * 100}), 99)
    with pytest.raises(a.Rejected):
        a.xml(b'<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>')


NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def test_pptx():
    shape = lambda t, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h|</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = lambda body: f"<p:sld {NS}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    files = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": REL.format("".join(f'<Relationship Id="r{i}" Target="slides/slide{i}.xml"/>' for i in (1, 2, 3))),
        "ppt/slides/slide1.xml": slide(shape("Title") + table), "ppt/slides/slide2.xml": slide(""), "ppt/slides/slide3.xml": slide(shape("Third")),
        "ppt/slides/_rels/slide3.xml.rels": REL.format('<Relationship Id="n" Target="../notesSlides/n.xml"/>'), "ppt/notesSlides/n.xml": slide(shape("say it", '<p:ph type="body"/>')),
    }
    assert a.pptx(packed(files), ignore) == "## Slide 1\n\nTitle\n\n| h\\| |\n| --- |\n|  |\n\n## Slide 2\n\nThird\n\n\n**Notes:** say it"


def test_xlsx_and_budget():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="str"><v>x|y</v></c><c r="C2"><v>1.50</v></c></row></sheetData></worksheet>'
    files = {"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Target="worksheets/s.xml"/>'), "xl/sharedStrings.xml": f"<sst {s}><si><t>na</t><t>me</t></si></sst>", "xl/worksheets/s.xml": sheet}
    assert list(a.xlsx_sheets(packed(files))) == [("S1", [["name", None, "n"], ["x|y", None, 1.5]])]
    assert a.xlsx(packed(files), ignore) == "## Sheet: S1\n\n| name | Unnamed: 1 |   n |\n|:-----|:-----------|----:|\n| x\\|y |            | 1.5 |"
    rows = [[i, "x" * 30] for i in range(400)]
    cut = a.within_budget(["a", "b"], rows)
    table, _, note = cut.partition("\n\n_(")
    assert len(table) <= 8000 < len(a.aligned_table(["a", "b"], rows[: table.count("\n")])) and note.startswith("truncated: 400 rows total")
    assert a.within_budget(["a" * 9000], [["x"]]).endswith("wide table)_")
    assert a.plain_sheets(iter([("S", [["a", None, 1]])])) == "--- Sheet: S ---\na\t\t1"


def test_xlsx_has_all_rows(spark):
    """F5 and F6 of r03: only the first rows of a long sheet were used."""
    from folio.plans.formats import xlsx_of
    from folio.sources.documents import with_text

    rows = [["name", "phone", "balance"], *([f"s{i}", f"no|{i}", f"{i}.50"] for i in range(600))]
    text = with_text(spark.createDataFrame([(".xlsx", xlsx_of(7, rows))], "ext string, content binary")).first().text
    lines = text.split("\n")
    assert len(text) > 8000 and len(lines) == 2 + 602 and lines[-1] == "| s599 | no\\|599 |   599.5 |" and "truncated" not in text


def test_csv_has_all_rows():
    """F3 of r03: a sheet of more than 8,000 characters was cut."""
    text = a.csv_text("\r\n".join(["name,n", *(f"Supplier#{i:09},{i}.25" for i in range(400))]).encode(), ignore)
    lines = text.split("\n")
    assert len(lines) == 2 + 402 and lines[-1] == "| Supplier#000000399 | 399.25 |" and "truncated" not in text


@pytest.mark.parametrize("encoding", ["utf-8", "big5", "cp950", "utf-16"])
def test_encodings(encoding):
    text = "繁體中文\r\n測試"
    assert a.decoded(text.encode(encoding), ignore) == text.replace("\r\n", "\n")


def test_broken_encoding_and_csv():
    found = []
    assert "�" in a.decoded(b"\xff\xfe\xfa\x81 a\xff", found.append) and found
    assert a.csv_text("名,n\na,1\n,2\n".encode("big5"), ignore).startswith("## Sheet: CSV\n\n| 名")


def test_dxf():
    pairs = [("0", "SECTION"), ("2", "TABLES"), ("0", "LAYER"), ("2", "0"), ("0", "LAYER"), ("2", "Walls"), ("0", "ENDSEC"), ("0", "SECTION"), ("2", "BLOCKS"), ("0", "BLOCK"), ("2", "*Model_Space"), ("0", "BLOCK"), ("2", "Door"), ("0", "ENDSEC"), ("0", "SECTION"), ("2", "ENTITIES")]
    pairs += [("0", "MTEXT"), ("1", "m\\Pn"), ("0", "TEXT"), ("1", " hello "), ("0", "DIMENSION"), ("1", "<>"), ("42", "1.23456"), ("0", "DIMENSION"), ("1", "5 m"), ("0", "INSERT"), ("2", "Door"), ("0", "ATTRIB"), ("1", "D1"), ("2", "NO"), ("0", "SEQEND"), ("0", "ENDSEC"), ("0", "EOF")]
    got = a.dxf("\n".join(f"  {c}\n{v}" for c, v in pairs).encode(), ignore)
    assert got == "## Annotations\n\n\nhello\nm\nn\n\n## Attributes\n\n\n- NO: D1\n\n## Dimensions\n\n\n- 1.2346\n- 5 m\n\n## Layers\n\n\n- Walls\n\n## Blocks\n\n\n- Door"


def book(spine, chapters, **extra):
    items = "".join(f'<item id="{i}" href="{h}"{p}/>' for i, h, p in chapters)
    refs = "".join(f'<itemref idref="{i}" linear="{n}"/>' for i, n in spine)
    opf = f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>C</dc:creator></metadata><manifest>{items}</manifest><spine>{refs}</spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
    return packed({"META-INF/container.xml": container, "OEBPS/content.opf": opf, **extra})


def test_epub():
    page = lambda h, b: f"<html><head><title>T</title></head><body>{h}<div><p>{b}</p></div></body></html>"
    spine = [("nav", "yes"), ("a", "yes"), ("gone", "yes"), ("n", "no"), ("b", "yes"), ("c", "yes")]
    chapters = [("nav", "nav.xhtml", ' properties="nav"'), ("a", "a%20b.xhtml#x", ""), ("n", "n.xhtml", ""), ("b", "../x/b.xhtml", ""), ("c", "c.xhtml", "")]
    content = {"OEBPS/a b.xhtml": page("<h3>One</h3>", "first ￼ text"), "x/b.xhtml": "<p>no heading", "OEBPS/n.xhtml": page("", "hidden"), "OEBPS/nav.xhtml": page("", "toc"), "OEBPS/c.xhtml": page("<h1> </h1>", "")}
    assert a.epub(book(spine, chapters, **content), ignore) == "# T\n作者：C\n\n## One\n\nfirst text\n\n## 章節 3\n\nno heading"
    locked = '<encryption xmlns:e="e"><e:CipherReference URI="OEBPS/{}"/></encryption>'
    assert "Rejected" in read_one(".epub", book(spine, chapters, **content, **{"META-INF/encryption.xml": locked.format("a.xhtml")}))[1][0]
    assert a.epub(book(spine, chapters, **content, **{"META-INF/encryption.xml": locked.format("f.otf")}), ignore)


def test_page_text_takes_leaf_blocks():
    assert a.page_text("<h2>H</h2><div>lost<p>a <b>b</b></p><blockquote><p>c</p></blockquote></div><script>x</script><p>H</p>") == ("H", "a b\n\nc")
    assert a.page_text("<title>t</title><body>only text") == ("t", "only text") and a.page_text("") == ("", "")


def test_keynote_trees():
    arch = lambda i, refs: {"header": {"identifier": i, "messageInfos": [{"objectReferences": refs}]}}
    document = {"chunks": [{"archives": [arch(1, [10]), arch(2, [11]), arch(3, [])]}], "x": {"slideTree": {"slides": [{"identifier": 2}, {"identifier": 3}, {"identifier": 1}]}}}
    objects = {"Index/Document.iwa": document, "Index/Slide-10.iwa": {"t": [{"text": ["a￼", " ", 5]}, {"text": "no"}]}, "Index/Slide-11.iwa": {}}
    assert a.keynote_slides(objects) == [(1, "Index/Slide-11.iwa"), (3, "Index/Slide-10.iwa")]
    assert list(a.texts_of(objects["Index/Slide-10.iwa"])) == ["a"]
    assert a.keynote_slides({"Index/Slide-2.iwa": {}, "Index/Slide-10.iwa": {}}) == [(1, "Index/Slide-2.iwa"), (2, "Index/Slide-10.iwa")]
    assert a.first_value({"a": {"k": None}, "b": [{"k": 1}]}, "k") == 1


def test_listing(tmp_path, spark):
    (tmp_path / "sub").mkdir()
    for name in ("b.TXT", "a.md", "skip.bin", "sub/c.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "leak.txt").symlink_to("/etc/hostname")
    names = lambda found: [x.removeprefix(f"{tmp_path}/") for x in found[0]]
    assert names(collect(str(tmp_path))) == ["a.md", "b.TXT"]
    assert names(collect(str(tmp_path), recursive=True)) == ["a.md", "b.TXT", "sub/c.txt"]
    assert collect(str(tmp_path), recursive=True, limit=2)[1] and not collect(str(tmp_path), recursive=True, limit=3)[1]
    assert collect(str(tmp_path / "nothing")) == ([], False) and collect(str(tmp_path / "skip.bin"))[0] == []
    assert distinct_paths(["b", "a", "b"]) == ["b", "a"]
    rows = read_files(spark, [str(tmp_path / "b.TXT"), str(tmp_path / "a.md")]).sort("pos").collect()
    assert [(r.filename, r.stem, r.ext, bytes(r.content)) for r in rows] == [("b.TXT", "b", ".txt", b"b.TXT"), ("a.md", "a", ".md", b"a.md")]
    assert read_folder(spark, str(tmp_path), recursive=True).where("ext = '.txt'").count() >= 2


def test_transcripts_agree(spark):
    from pyspark.sql import functions as F

    from folio.sources import transcripts as t

    use = {"type": "tool_use", "id": "u1", "name": "Read", "input": {"zzz": 1, "other": "o" * 70}}
    entries = [
        {"type": "user", "sessionId": "session-1", "timestamp": "2024-01-02T03:04:05Z", "message": {"content": " hi "}}, {"type": "summary"},
        {"type": "assistant", "sessionId": "session-1", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, use, {"type": "thinking", "thinking": None}]}},
        {"type": "user", "sessionId": "session-2", "timestamp": "bad", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": "x"}]}},
        {"type": "user", "sessionId": "session-1", "message": {"content": [{"type": "tool_result", "tool_use_id": "u1", "content": [{"type": "text", "text": " a "}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "tool_use_id": "?", "content": ""}]}},
        {"type": "assistant", "message": {"content": "text only"}}, {"type": "user", "message": None},
    ]
    lines = [*(json.dumps(e) for e in entries), "{broken", "[1]", ""]
    whole = t.render_transcript("\n".join(lines).encode(), ignore)
    assert whole.startswith("## Session session-\n_2024-01-02_\n\n**User** · 03:04\n\nhi\n\n---\n\n**Assistant**\n\n<details><summary>thinking</summary>\n\nhm\n\n</details>\n\nok\n\n🔧 Read: " + "o" * 60 + "…")
    assert "tool_result (Read)</summary>\n\na\nb" in whole and "tool_result (tool)" in whole and "## Session unknown\n\n**Assistant**" in whole
    table = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line long, value string")
    found = t.transcripts(t.sessions(t.turns(t.blocks(table, "file"), "file"), "file"), "file")
    assert found.select(F.col("markdown")).first()[0] == whole
