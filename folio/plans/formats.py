"""Queries over files made of the tables' rows - documents, slides, sheets, drawings, books, PDF elements - and read again, with their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.catalogue import ORACLE_SQL, QUERIES, SPACED_SQL, epub_books, query, row_budget_xlsx, suppliers_by_nation, table, texts, transcript_tools
from folio.sources.documents import with_text

KEPT = """
r AS (SELECT s_nationkey AS k, s_suppkey, 'no|' || s_suppkey AS code, trim(s_name) AS name, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier)"""


def packed(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in entries.items():
            archive.writestr(name, data)
    return out.getvalue()


def nation_files(spark: SparkSession, sf_dir: str, ext: str, build: Callable[[int, list], bytes]) -> DataFrame:
    """(k, text): a file of each nation's suppliers, written by ``build`` and read by its extension."""

    @F.pandas_udf("binary")
    def content(key: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([build(int(k), [list(r) for r in own]) for k, own in zip(key, rows)])

    files = suppliers_by_nation(spark, sf_dir).select(F.col("s_nationkey").cast("int").alias("k"), F.lit(ext).alias("ext"), content("s_nationkey", "rows").alias("content"))
    return with_text(files).select("k", "text")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx_of(key: int, rows: list) -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    lines = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    wide = f'<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("both")}</w:tc><w:tc>{p("end")}</w:tc></w:tr>'
    return packed({"word/document.xml": f"<w:document {W}><w:body>{p(f'Nation {key}')}{p(' ')}<w:tbl>{lines}{wide}</w:tbl>{p('after')}</w:body></w:document>"})


@query(f"SELECT s_nationkey AS k, 'Nation ' || s_nationkey || chr(10) || chr(10) || markdown || chr(10) || '| both |  | end |' || chr(10) || chr(10) || 'after' AS text FROM ({SPACED_SQL})")
def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word documents: paragraphs (blank ones left out), a table, a cell over two columns."""
    return nation_files(spark, sf_dir, ".docx", docx_of)


NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def pptx_of(key: int, rows: list) -> bytes:
    body = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    shape = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody>{body(t)}</p:txBody></p:sp>"
    grid = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{body(c)}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    slide = lambda x: f"<p:sld {NS}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    return packed({
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": LINKS.format("".join(f'<Relationship Id="r{i}" Target="slides/slide{i}.xml"/>' for i in (1, 2, 3))),
        "ppt/slides/slide1.xml": slide(shape(f"Nation {key}")), "ppt/slides/slide2.xml": slide(""), "ppt/slides/slide3.xml": slide(f"<p:graphicFrame><a:tbl>{grid}</a:tbl></p:graphicFrame>"),
        "ppt/slides/_rels/slide3.xml.rels": LINKS.format('<Relationship Id="n" Target="../notesSlides/n.xml"/>'), "ppt/notesSlides/n.xml": slide(shape(f"note {key}", '<p:ph type="body"/>')),
    })


@query(f"SELECT s_nationkey AS k, '## Slide 1' || chr(10) || chr(10) || 'Nation ' || s_nationkey || chr(10) || chr(10) || '## Slide 2' || chr(10) || chr(10) || markdown || chr(10) || chr(10) || chr(10) || '**Notes:** note ' || s_nationkey AS text FROM ({SPACED_SQL})")
def pptx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations: a title, an empty slide that doesn't count, a table with notes."""
    return nation_files(spark, sf_dir, ".pptx", pptx_of)


SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def xlsx_of(key: int, rows: list) -> bytes:
    word = lambda t: f'<c t="inlineStr"><is><t>{escape(t)}</t></is></c>'
    head = "<row>" + "".join(map(word, rows[0])) + "</row>"
    body = "".join(f"<row>{word(a)}{word(b)}<c><v>{c}</v></c></row>" for a, b, c in rows[1:])
    files = {"xl/workbook.xml": f'<workbook {SHEET}><sheets><sheet name="N{key}" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": LINKS.format('<Relationship Id="r1" Target="worksheets/s.xml"/>')}
    return packed({**files, "xl/worksheets/s.xml": f"<worksheet {SHEET}><sheetData>{head}{body}</sheetData></worksheet>"})


def sheet_sql(heading: str) -> str:
    """Three padded columns, the last of numbers; all rows."""
    return rf"""
WITH {KEPT},
c AS (SELECT k, s_suppkey, name AS a, replace(code, '|', '\|') AS b, CASE WHEN balance = round(balance) THEN CAST(CAST(balance AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', balance) END AS c FROM r),
w AS (SELECT k, greatest(13, max(length(a))) AS wa, greatest(5, max(length(b))) AS wb, greatest(7, max(length(c))) AS wc FROM c GROUP BY k)
SELECT k, {heading} || chr(10) || chr(10) || '| ' || rpad('name \| alias', wa::INT, ' ') || ' | ' || rpad('phone', wb::INT, ' ') || ' | ' || lpad('balance', wc::INT, ' ') || ' |' || chr(10)
  || '|:' || repeat('-', wa::INT + 1) || '|:' || repeat('-', wb::INT + 1) || '|' || repeat('-', wc::INT + 1) || ':|' || chr(10)
  || string_agg('| ' || rpad(a, wa::INT, ' ') || ' | ' || rpad(b, wb::INT, ' ') || ' | ' || lpad(c, wc::INT, ' ') || ' |', chr(10) ORDER BY s_suppkey) AS text
FROM c JOIN w USING (k) GROUP BY k, wa, wb, wc"""


@query(sheet_sql("'## Sheet: N' || k"))
def xlsx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with words and numbers."""
    return nation_files(spark, sf_dir, ".xlsx", xlsx_of)


def csv_of(key: int, rows: list) -> bytes:
    line = lambda r: ",".join('"' + c.replace('"', '""') + '"' for c in r)
    return "\r\n".join(map(line, rows)).encode(("utf-8", "big5", "cp950", "utf-16")[key % 4])


@query(sheet_sql("'## Sheet: CSV'"))
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files in four encodings."""
    return nation_files(spark, sf_dir, ".csv", csv_of)


def dxf_of(key: int, rows: list) -> bytes:
    pairs = [("0", "SECTION"), ("2", "TABLES"), ("0", "LAYER"), ("2", "0"), ("0", "LAYER"), ("2", f"Layer {key}"), ("0", "ENDSEC"), ("0", "SECTION"), ("2", "ENTITIES")]
    for name, code, balance in rows[1:]:
        pairs += [("0", "TEXT"), ("1", f" {name} "), ("0", "DIMENSION"), ("1", "<>"), ("42", balance), ("0", "INSERT"), ("2", "Door"), ("0", "ATTRIB"), ("1", code), ("2", "NO"), ("0", "SEQEND")]
    return "\n".join(f"  {c}\n{v}" for c, v in [*pairs, ("0", "ENDSEC"), ("0", "EOF")]).encode()


@query(f"""
WITH {KEPT}, f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s_suppkey) AS n FROM r)
SELECT k, '## Annotations' || repeat(chr(10), 3) || string_agg(name, chr(10) ORDER BY n) || repeat(chr(10), 2) || '## Attributes' || repeat(chr(10), 3) || string_agg('- NO: ' || code, chr(10) ORDER BY n) || repeat(chr(10), 2)
  || '## Dimensions' || repeat(chr(10), 3) || string_agg('- ' || CAST(round(balance, 4) AS VARCHAR), chr(10) ORDER BY n) || repeat(chr(10), 2) || '## Layers' || repeat(chr(10), 3) || '- Layer ' || k AS text
FROM f WHERE n <= 5000 GROUP BY k""")
def dxf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings: annotations, attributes of inserted blocks, measured dimensions, layers."""
    return nation_files(spark, sf_dir, ".dxf", dxf_of)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') || chr(10) || 'end' WHEN 1 THEN coalesce(text, '') || chr(10) || 'end' WHEN 2 THEN '繁體中文 ' || doc_id || chr(10) || '測試' ELSE '繁體中文 ' || doc_id || chr(10) || '測試' END AS text FROM documents")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in four encodings with other line ends."""
    chinese = F.concat(F.lit("繁體中文 "), F.col("doc_id").cast("string"), F.lit("\r\n測試"))
    k = F.col("doc_id") % 4

    @F.pandas_udf("binary")
    def big5(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t.encode("big5"))

    whole = F.concat(F.coalesce("text", F.lit("")), F.lit("\r\nend"))
    content = F.when(k == 0, F.encode(whole, "utf-8")).when(k == 1, F.encode(whole, "utf-16")).when(k == 2, big5(chinese)).otherwise(F.encode(chinese, "utf-8"))
    files = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.lit(".txt").alias("ext"), content.alias("content"))
    return with_text(files).select("doc_id", "text")


# --- PDF elements -------------------------------------------------------------------------

PDF_PROSE = "an order with its lines as a table on two pages; "


@query(f"""
WITH l AS (SELECT l_orderkey AS pos, l_linenumber AS n, l_partkey AS p, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i FROM lineitem),
s AS (SELECT *, 'q' || i || '|line ' || n || '|' || p || '|' AS line FROM l)
SELECT pos, 'Order ' || pos || chr(10) || chr(10) || '|no|line|part|' || chr(10) || '|---|---|---|' || chr(10) || string_agg('|' || line, chr(10) ORDER BY i) AS text, 'native' AS type, 'text' AS source FROM s GROUP BY pos""")
def pdf_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as PDF elements: rows that collapsed into their first cell, a table that goes on over the page, classified and routed."""
    from pyspark.sql import Window

    from folio.operators.pdf_text import rendered, routed

    items = table(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    own = items.select(F.col("l_orderkey").alias("pos"), i.alias("i"), F.col("l_linenumber").cast("string").alias("n"), F.col("l_partkey").cast("string").alias("p"))
    box = lambda a: F.struct(F.lit(float(a)).alias("x0"), F.lit(float(a + 100)).alias("x1"))
    word = lambda x, y, t: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + 20)).alias("x1"), t.alias("text"))
    number = F.concat(F.lit("q"), F.col("i").cast("string"))
    cells = F.array(F.concat_ws(" ", number, F.lit("line"), F.col("n"), F.col("p")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    words = F.array(word(210, 1, F.col("p")), word(110, 9, F.col("n")), word(110, 1, F.lit("line")), word(10, 1, number))
    lines = own.withColumns({"page": F.when(F.col("i") <= 2, 1).otherwise(2), "row": F.struct("i", cells.alias("cells"), words.alias("words"))})
    tables = lines.groupBy("pos", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("row.i").alias("i"), F.col("row.cells").alias("cells"), F.col("row.words").alias("words")))).alias("r"))
    heads, collapsed = F.array(box(0), box(100), box(200)), F.array(box(0), F.lit(None).cast("struct<x0:double,x1:double>"), F.lit(None).cast("struct<x0:double,x1:double>"))
    geometry = {"y": F.lit(10.0), "y1": F.lit(30.0), "x0": F.lit(0.0), "x1": F.lit(300.0)}
    of_table = tables.withColumns({
        "seq": F.lit(1), "kind": F.lit("table"), **geometry, "header": F.array(F.lit("no"), F.lit("line"), F.lit("part")), "rows": F.transform("r", lambda x: x["cells"]),
        "boxes": F.concat(F.array(heads), F.transform("r", lambda x: collapsed)), "words": F.concat(F.array(F.expr("cast(array() as array<struct<x0:double,y0:double,x1:double,text:string>>)")), F.transform("r", lambda x: x["words"])), "text": F.lit(None).cast("string"),
    }).drop("r")
    title = own.where("i = 1").select("pos", F.lit(1).alias("page"), F.lit(0).alias("seq"), F.lit("text").alias("kind"), F.lit(0.0).alias("y"), F.lit(9.0).alias("y1"), F.lit(0.0).alias("x0"), F.lit(300.0).alias("x1"), F.concat(F.lit(" Order "), F.col("pos").cast("string")).alias("text"))
    found = rendered(of_table.unionByName(title, allowMissingColumns=True))
    plain = own.where("i = 1").select("pos", F.repeat(F.lit(PDF_PROSE), F.lit(9)).alias("text"), F.lit(2).alias("pages"))
    return routed(plain, found)


# --- SQL of queries that the catalogue has without --------------------------------------------

ORACLE_SQL[transcript_tools.__name__] = r"""
WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0)
SELECT CAST(e.user_id AS VARCHAR) AS session, event_id AS line, CASE WHEN event_id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN event_id % 2 = 0 THEN '**Assistant**' ELSE '**User**' END || ' · ' || strftime(ts, '%H:%M') || chr(10) || chr(10)
  || CASE WHEN event_id % 2 = 0 THEN '🔧 Tool-' || e.event_type || ': ' || CASE WHEN length(trim(props)) <= 60 THEN trim(props) ELSE left(trim(props), 60) || '…' END
     ELSE '<details><summary>tool_result (' || coalesce('Tool-' || u.event_type, 'tool') || ')</summary>' || chr(10) || chr(10) || trim(props) || chr(10) || chr(10) || '</details>' END AS markdown
FROM events e LEFT JOIN u ON u.user_id = e.user_id AND u.event_type = e.event_type"""

ORACLE_SQL[row_budget_xlsx.__name__] = """
WITH c AS (SELECT c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS k, c_name AS v, row_number() OVER w AS n, greatest(3, max(length(CAST(c_custkey AS VARCHAR))) OVER w) AS wk, greatest(4, max(length(c_name)) OVER w) AS wv
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)),
s AS (SELECT segment, max(n) AS total, max(CASE WHEN n = 1 OR (n + 2) * (wk + wv + 7) + n + 1 <= 8000 THEN n END) AS shown FROM c GROUP BY segment),
p AS (SELECT c.*, s.total, s.shown, max(wk) OVER (PARTITION BY segment) AS a, max(wv) OVER (PARTITION BY segment) AS b FROM c JOIN s USING (segment) WHERE n <= shown)
SELECT segment, '| ' || lpad('key', a::INT, ' ') || ' | ' || rpad('name', b::INT, ' ') || ' |' || chr(10) || '|' || repeat('-', a::INT + 1) || ':|:' || repeat('-', b::INT + 1) || '|' || chr(10)
  || string_agg('| ' || lpad(k, a::INT, ' ') || ' | ' || rpad(v, b::INT, ' ') || ' |', chr(10) ORDER BY n)
  || CASE WHEN shown < total THEN chr(10) || chr(10) || '_(truncated: ' || total || ' rows total, showing ' || shown || ' / 截斷：原始共 ' || total || ' 行，顯示 ' || shown || ' 行)_' ELSE '' END AS markdown
FROM p GROUP BY segment, a, b, total, shown"""

ORACLE_SQL[epub_books.__name__] = """
SELECT item_id, '# Item ' || item_id || chr(10) || '作者：folio' || chr(10) || chr(10) || '## Item ' || item_id || chr(10) || chr(10)
  || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM benchmark"""


# --- Markdown on a subset that SQL can render too -----------------------------------------------


def simple_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a heading, a paragraph, two list items and a rule."""
    name = F.concat(F.lit("p & "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("# "), name, F.lit("\n\n<plain> text "), F.col("p_partkey").cast("string"), F.lit("\n\n- a "), name, F.lit("\n- b")).alias("markdown"))


def rendered_sql(rule: str) -> str:
    return f"SELECT p_partkey, '<h1>p &amp; ' || p_partkey || '</h1>' || chr(10) || '<p>&lt;plain&gt; text ' || p_partkey || '</p>' || chr(10) || {rule} AS html FROM part"


@query(rendered_sql("'<ul>' || chr(10) || '<li>a p &amp; ' || p_partkey || '</li>' || chr(10) || '<li>b</li>' || chr(10) || '</ul>'"))
def xhtml_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.functions.markup import markdown_to_xhtml

    return simple_markdown(spark, sf_dir).select("p_partkey", markdown_to_xhtml("markdown").alias("html"))


@query(rendered_sql("'<ul><li>a p &amp; ' || p_partkey || '</li><li>b</li></ul>'"))
def preview_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.functions.markup import markdown_to_html

    return simple_markdown(spark, sf_dir).select("p_partkey", markdown_to_html("markdown").alias("html"))


@query(r"SELECT p_partkey, 'p | ' || p_partkey || ' ; b\ ; ' AS cells, 'k ' || p_partkey AS title, '# body' AS body FROM part")
def pipe_rows_and_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pipe tables in cells again, and the head of a Markdown file."""
    from folio.functions.markup import split_frontmatter, split_row

    @F.pandas_udf("cells string, title string, body string")
    def parts(row: pd.Series, file: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(" ; ".join(split_row(r)), *split_frontmatter(f)) for r, f in zip(row, file)], columns=["cells", "title", "body"])

    key = F.col("p_partkey").cast("string")
    row, file = F.concat(F.lit(r"| p \| "), key, F.lit(r" | b\\ |  |")), F.concat(F.lit("---\ntitle: \"k "), key, F.lit("\"\n---\n# body"))
    return table(spark, sf_dir, "part").select("p_partkey", parts(row, file).alias("x")).select("p_partkey", "x.*")


# --- runs ------------------------------------------------------------------------------------


class Echo:
    """A client whose answers depend on the text: sound, cut off, none."""

    def call(self, prompt: str, images: object, text: str) -> str:
        kind = len(text) % 3
        if kind == 2:
            raise ConnectionError("no answer")
        return '{"title": "t%d", "refined_markdown": "body %d"%s' % (len(text), len(text), "}" if kind == 0 else "")


@query("""
SELECT doc_id, CASE WHEN length(text) % 3 = 2 THEN NULL ELSE 't' || length(text) END AS title, CASE WHEN length(text) % 3 = 2 THEN NULL ELSE 'body ' || length(text) END AS body,
  CASE WHEN length(text) = 0 AND length(text) % 3 = 2 THEN 'error' ELSE 'ok' END AS status, CASE WHEN length(text) % 3 = 2 THEN 'ConnectionError: no answer' END AS error
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model stage with a client that fails for a third of the texts: those keep their raw text."""
    from folio.model.stage import settled, with_answers

    asked = with_answers(texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), Echo, "prompt", retries=0)
    return settled(asked).select("doc_id", F.col("answer.title").alias("title"), F.col("answer.refined_markdown").alias("body"), "status", F.col("model_error").alias("error"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))


@query("""
WITH f AS (SELECT DISTINCT source || '/' || lang || CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.v1.pdf' END AS path FROM documents)
SELECT path, split_part(path, '/', 2) AS filename, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.txt', '.md', '.pdf') AS supported FROM f""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a listing in parts, and which have a supported extension."""
    from folio.config import EXTENSIONS
    from folio.sources.files import file_rows

    k = F.col("doc_id") % 5
    end = F.when(k == 0, ".TXT").when(k == 1, ".md").when(k == 2, ".exe").when(k == 3, "").otherwise(".v1.pdf")
    files = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", end).alias("path")).distinct()
    return file_rows(files).select("path", "filename", "ext", F.col("ext").isin(*EXTENSIONS).alias("supported"))


__all__ = ["ORACLE_SQL", "QUERIES"]
