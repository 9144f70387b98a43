"""Markdown to XHTML (books) and to safe HTML (previews): line machines, run as Arrow UDFs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORBIDDEN = dict.fromkeys([*range(9), 11, 12, *range(14, 32), *range(0xD800, 0xE000), 0xFFFE, 0xFFFF])
MAX_RUN = 50_000
MAX_PREVIEW_BYTES = 5_000_000
SCHEMES = ("http://", "https://", "mailto:")


def xml_text(value: object) -> str:
    return html.escape(str(value).translate(FORBIDDEN), quote=False).replace('"', "&quot;")


# --- books --------------------------------------------------------------------------------


def book_inline(escaped: str) -> str:
    """Code, bold and italics in text that is escaped; code is escaped once more, as its readers expect."""
    out = re.sub(r"`([^`]+)`", lambda m: f"<code>{xml_text(m[1])}</code>", escaped)
    for pattern, tag in ((r"\*\*(.*?)\*\*", "strong"), (r"\*(.*?)\*", "em"), (r"_(.*?)_", "em")):
        out = re.sub(pattern, rf"<{tag}>\1</{tag}>", out)
    return out


def book_cells(row: str) -> list[str]:
    """Cells between all pipes, escaped ones too; an empty one at either edge goes."""
    cells = [c.strip() for c in row.split("|")]
    return cells[cells[:1] == [""] : len(cells) - (len(cells) > 1 and cells[-1] == "")]


def book_table(rows: list[str]) -> str:
    def line(cells: list[str], tag: str) -> list[str]:
        return ["<tr>", *(f"<{tag}>{book_inline(xml_text(c))}</{tag}>" for c in cells), "</tr>"]

    out = ["<table>"]
    headed = len(rows) > 1 and re.fullmatch(r"\|?\s*(?::?-+:?\s*\|?\s*)+", rows[1].strip())
    if headed:
        head = "".join(line(book_cells(rows[0]), "th"))
        cells = re.findall(r"<th>.*?</th>", head, re.S)
        out += ["<thead><tr>", *cells, "</tr></thead>"]
    out.append("<tbody>")
    for row in rows[2 if headed else 0 :]:
        out += line(book_cells(row), "td")
    return "\n".join([*out, "</tbody>", "</table>"])


def to_xhtml(text: str) -> str:
    """One element per line, lists and tables gathered; a code fence that isn't closed stays open."""
    out: list[str] = []
    listed, rows, fenced = "", [], False

    def settle(kind: str = "") -> None:
        nonlocal listed
        if rows:
            out.append(book_table(rows))
            rows.clear()
        if listed != kind:
            if listed:
                out.append(f"</{listed}>")
            if kind:
                out.append(f"<{kind}>")
            listed = kind

    for line in text.splitlines():
        bare = line.strip()
        content = lambda s: book_inline(xml_text(s))
        if bare.startswith("```"):
            settle()
            out.append("</code></pre>" if fenced else "<pre><code>")
            fenced = not fenced
        elif fenced:
            out.append(xml_text(line))
        elif bare.startswith("|"):
            if listed:
                settle()
            rows.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)$", line):
            settle()
            out.append(f"<h{len(m[1])}>{content(m[2])}</h{len(m[1])}>")
        elif bare.startswith(">"):
            settle()
            out.append(f"<blockquote>{content(bare[1:].strip())}</blockquote>")
        elif m := re.match(r"[*+-]\s+(.*)$", bare):
            settle("ul")
            out.append(f"<li>{content(m[1])}</li>")
        elif m := re.match(r"\d+\.\s+(.*)$", bare):
            settle("ol")
            out.append(f"<li>{content(m[1])}</li>")
        else:
            settle()
            if bare:
                out.append(f"<p>{content(line)}</p>")
    settle()
    return "\n".join(out)


# --- previews -----------------------------------------------------------------------------

HEADING, RULE = re.compile(r"(#{1,6})\s+(.*)$"), re.compile(r"(?:-{3,}|\*{3,}|_{3,})\Z")
BULLET, NUMBER = re.compile(r"\s*[-*+]\s+"), re.compile(r"\s*\d+\.\s+")
DELIMITER = re.compile(r"\s*\|(?:\s*:?-+:?\s*\|)+\s*\Z")


LINK = re.compile(r"\[(?P<label>[^]]*)\][(](?P<url>[^)]+)[)]")


def between(mark: str, alone: bool = False) -> re.Pattern:
    """Text between two marks without the mark's sign; ``alone``: not within a word."""
    before, after = ("(?<!\\w)", "(?!\\w)") if alone else ("", "")
    sign = re.escape(mark)
    return re.compile(f"{before}{sign}(?P<inner>[^{mark[0]}]+){sign}{after}")


EMPHASIS = ((between("**"), "strong"), (between("__"), "strong"), (between("*"), "em"), (between("_", True), "em"))


def escape(text: str) -> str:
    return html.escape(text, quote=True)


def link(m: re.Match) -> str:
    """A link of an allowed scheme whose address has nothing suspicious; any other stays text."""
    label, url = m[1], m[2]
    clean = not re.search(r"&quot;|&lt;|&gt;|&#x27;|[ \t]", url)
    return f'<a href="{url}">{label}</a>' if clean and url.lower().startswith(SCHEMES) else m[0]


def preview_inline(text: str) -> str:
    """Inline markup of escaped text; code spans are set aside; very long runs are escaped only."""
    if len(text) > MAX_RUN:
        return escape(text)
    spans: list[str] = []

    def aside(m: re.Match) -> str:
        spans.append(f"<code>{escape(m[1])}</code>")
        return f"\0{len(spans) - 1}\0"

    out = LINK.sub(link, escape(re.sub(r"`([^`]+)`", aside, text)))
    for pattern, tag in EMPHASIS:
        out = pattern.sub(lambda m, tag=tag: f"<{tag}>{m['inner']}</{tag}>", out)
    return re.sub(r"\0(\d+)\0", lambda m: spans[int(m[1])], out)


def split_row(line: str) -> list[str]:
    """Cells between pipes that no backslash escapes; a backslash goes, what it escapes stays; empty edges go."""
    parts = re.split(r"((?:\\.|[^|\\]|\\\Z)+)|(\|)", line.strip(), flags=re.S)
    cells = [""]
    for text, pipe in zip(parts[1::3], parts[2::3]):
        if pipe:
            cells.append("")
        else:
            cells[-1] = re.sub(r"\\(.)", r"\1", text, flags=re.S).strip()
    return cells[cells[0] == "" : len(cells) - (len(cells) > 1 and cells[-1] == "")]


def unquoted(value: str) -> str:
    """A YAML value without the quotes around it and with its escapes undone."""
    return value.removeprefix('"').removesuffix('"').replace('\\"', '"').replace("\\\\", "\\")


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """Title (if any) and body; a block that never ends is body."""
    lines = text.split("\n")
    if lines[0].strip() == "---":
        for end, line in enumerate(lines[1:], 1):
            if line.strip() == "---":
                named = [value.strip() for key, colon, value in (x.partition(":") for x in lines[1:end]) if colon and key.strip() == "title"]
                title = unquoted(named[0]) if named else None
                return title, "\n".join(lines[end + 1 :])
    return None, text


def preview_blocks(text: str) -> Iterator[str]:
    lines = text.split("\n")
    n, i = len(lines), 0

    def is_table(k: int) -> bool:
        return "|" in lines[k] and k + 1 < n and DELIMITER.match(lines[k + 1]) is not None

    def begins(k: int) -> bool:
        bare = lines[k].strip()
        return not bare or bare.startswith(("```", ">")) or any(p.match(lines[k]) for p in (HEADING, BULLET, NUMBER)) or RULE.match(bare) is not None or is_table(k)

    def run(test) -> list[str]:
        nonlocal i
        start = i
        while i < n and test(i):
            i += 1
        return lines[start:i]

    while i < n:
        line, bare = lines[i], lines[i].strip()
        if not bare:
            i += 1
        elif bare.startswith("```"):
            i += 1
            code = run(lambda k: not lines[k].strip().startswith("```"))
            i += 1
            yield f"<pre><code>{escape(chr(10).join(code))}</code></pre>"
        elif m := HEADING.match(line):
            i += 1
            yield f"<h{len(m[1])}>{preview_inline(m[2].strip())}</h{len(m[1])}>"
        elif RULE.match(bare):
            i += 1
            yield "<hr>"
        elif is_table(i):
            i += 2
            head = "".join(f"<th>{preview_inline(c)}</th>" for c in split_row(line))
            body = ("".join(f"<td>{preview_inline(c)}</td>" for c in split_row(x)) for x in run(lambda k: lines[k].strip() and "|" in lines[k]))
            yield f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(f'<tr>{x}</tr>' for x in body)}</tbody></table>"
        elif bare.startswith(">"):
            quoted = [re.sub(r"^\s*>\s?", "", x) for x in run(lambda k: lines[k].strip().startswith(">"))]
            yield f"<blockquote>{preview_inline(' '.join(quoted).strip())}</blockquote>"
        elif BULLET.match(line) or NUMBER.match(line):
            mark, tag = (BULLET, "ul") if BULLET.match(line) else (NUMBER, "ol")
            items = run(lambda k: mark.match(lines[k]))
            yield f"<{tag}>" + "".join(f"<li>{preview_inline(mark.sub('', x, count=1).strip())}</li>" for x in items) + f"</{tag}>"
        else:
            first, i = bare, i + 1
            rest = [x.strip() for x in run(lambda k: not begins(k))]
            yield f"<p>{preview_inline(' '.join([first, *rest]))}</p>"


def to_html(text: str) -> str:
    """A safe preview: everything is escaped first, only known tags are written."""
    title, body = split_frontmatter(text.replace("\0", ""))
    head = [f'<p class="meta">{escape(title)}</p>'] if title else []
    return "\n".join([*head, *preview_blocks(body)]) if text else ""


def preview(text: str | None) -> str | None:
    """``to_html`` of a text of at most ``MAX_PREVIEW_BYTES``, None for any other."""
    return None if text is None or len(text.encode()) > MAX_PREVIEW_BYTES else to_html(text)


@F.pandas_udf(T.StringType())
def markdown_to_xhtml(text: pd.Series) -> pd.Series:
    return text.map(to_xhtml, na_action="ignore")


@F.pandas_udf(T.StringType())
def markdown_to_html(text: pd.Series) -> pd.Series:
    return text.map(preview, na_action="ignore")
