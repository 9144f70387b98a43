import random
import time
from html.parser import HTMLParser

import pytest

from folio.llm.html_text import CELL_WIDTH, TABLE_WIDTH, extract, render


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        (None, ""), ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b <b>c</b>d", "a\n\nb cd"), ("a<div>b</div>c<br>d", "a\nb\nc\nd"), ("a<br><br>b", "a\n\nb"), ("<h1>T</h1>x<hr>y", "T\n\nx\n\n---\n\ny"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n    3. x\n    4. y\n- c"), ("<pre>\n a\n  b </pre>", " a\n  b"), ("<blockquote>a<p>b</blockquote>", "> a\n>\n> b"), ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<script>x</script><style>y</style><template>z</template><!-- c --><title>t</title>v", "v"), ('<p hidden>a</p><i style="x:y; DISPLAY : none">b</i><input type=hidden value=c>d', "d"),
        ("<style>.z, p#q { visibility:hidden } b{color:red}</style><i class='y z'>no</i><p id=q>no</p><b>yes</b>", "yes"), ("1 < 2 <3 &lt;b&gt; &copy;&nbsp;x", "1 < 2 <3 <b> ©\xa0x"), ("<p>a</div>b</p></p>c", "ab\n\nc"),
        ("<table><tr><th>Name<th>N<tr><td>apple<td>2</table>", "Name   N\napple  2"), ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab     c\n1   2  3"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><caption>C</caption><tr><td>a<br>b<td>x</table>", "C\na  x\nb"), ("<table><tr><td>one<tr><td>two</table>", "one\ntwo"), ("<table><tr><td>漢字<td>x<tr><td>a<td>y</table>", "漢字  x\na     y"), ("<select><option>a<option>b</select>", "a\nb"),
        ("<a href='x'>l</a><img alt='pic'> <textarea> t </textarea>", "lpic t"), ("<script>unclosed", ""), ("<p title=\"a>b\">c", "c"), ("<", "<"),
        ("a<svg><title>t</title><desc>d</desc><text>one</text><text>two</text></svg>b", "a\none\ntwo\nb"), ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math> y", "x= y"), ("<map><p>in</p></map>", "in"), ("\u0130" * 20 + "<script>s</script>v", "\u0130" * 20 + "v"),
        ("<ul><li><ul></ul><li><p>a<p>b</ul>", "- a\n\n  b"), ("<blockquote><ul><li>a</ul><p>c</blockquote>d", "> - a\n>\n> c\n\nd"),
    ],
)
def test_rendering(source, expected):
    assert render(source) == expected


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, deep), (2, "<b>" * 50_000 + "y"), (3, "<p>word" * 20_000), (None, None), (1, deep)]
    table = spark.createDataFrame([(i, "u", h, "c") for i, h in rows], "page_id long, url string, html string, text string")
    got = extract(table).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "3", "None"]
    assert {r.page_id: r.text for r in got}[2] == "y" and {r.page_id: r.text for r in got}[1] == "x"
    assert extract(table.limit(0)).count() == 0


HOSTILE = {
    "divs": "<div>" * 100_000 + "x", "lists": "<ul><li>y" * 30_000, "paragraph": "<p>" + "<span>" * 50_000 + "<div>" * 50_000 + "z", "button": "<p><button>" + "<div>" * 100_000 + "b",
    "cell": "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>c<td>" + "word " * 200_000, "long word": "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>c<td>" + "w" * 1_000_000,
    "spans": "<table>" + "<tr><td colspan=1000>a<td>b" * 20_000, "tables": "<table><tr><td>q<td>" * 20_000, "scripts": "<script>x</script>y" * 50_000, "quotes": "<blockquote>t" * 30_000, "definitions": "<dl><dd>a" * 30_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_deep_and_wide_markup(name):
    source, start = HOSTILE[name], time.perf_counter()
    text = render(source)
    assert time.perf_counter() - start < 20 and len(text) < 40 * len(source)
    for word in ("word", "q", "w" * CELL_WIDTH):
        assert text.count(word) == (source.count(word) if name in ("cell", "tables", "long word") else text.count(word))


def test_wide_tables_are_bounded():
    text = render("<table><tr>" + ("<td>" + "x" * 90) * 200 + "<tr><td colspan=199>a<td>b</table>")
    assert max(map(len, text.split("\n"))) <= 200 * 92 and len(text.split("\n")[1]) <= TABLE_WIDTH + 2
    assert "".join(text.split()) == "x" * 90 * 200 + "ab"


class Walker(HTMLParser):
    """Visible words by nothing but the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "img", "hr"):
            self.hidden.append(tag in ("script", "style", "title") or "hidden" in dict(attrs))
        self.out.append(" " if tag not in ("b", "i", "span") else "")

    def handle_endtag(self, tag):
        self.hidden.pop()
        self.out.append(" " if tag not in ("b", "i", "span") else "")

    def handle_data(self, data):
        if not any(self.hidden):
            self.out.append(data)


def made(rng, depth=0):
    """Well-formed random markup; words are unlike any marker."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["w", "w", "b", "i", "span", "div", "p", "ul", "blockquote", "section", "hidden", "script", "h2", "br", "table"] if depth < 5 else ["w"])
        words = " ".join(f"w{rng.randint(0, 10**6)}&amp;" for _ in range(rng.randint(1, 30))) + " "
        inner = made(rng, depth + 1) if kind not in ("w", "br", "script") and kind not in ("p", "h2", "b", "i", "span") else words
        if kind == "ul":
            inner = "".join(f"<li>{made(rng, depth + 2)}</li>" for _ in range(rng.randint(0, 3)))
        if kind == "table":
            inner = "".join(f"<tr><td>{words}</td></tr>" for _ in range(rng.randint(1, 3)))
        out.append({"w": words, "br": "<br>", "hidden": f"<div hidden>{inner}</div>"}.get(kind, f"<{kind}>{inner}</{kind}>"))
    return "".join(out)


def test_visible_words_in_order():
    rng = random.Random(5)
    for _ in range(300):
        source = made(rng)
        walker = Walker()
        walker.feed(source)
        walker.close()
        expected = [w for w in "".join(walker.out).split() if w.startswith("w")]
        got = [w for w in render(source).split() if w.startswith("w")]
        assert got == expected, source
