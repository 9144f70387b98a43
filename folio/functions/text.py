"""Text expressions: white space, cells, URLs, YAML and XML escapes, Markdown frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once; a lambda evaluates any other expression again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(text: Column) -> Column:
    """Both ends without Unicode white space."""
    return F.regexp_replace(text, rf"{WS}+\z|(?U)\A\s+", "")


def rtrim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WS}+\z", "")


def normalize_cell(cell: Column) -> Column:
    """A table cell as one line: null is '', runs of white space are one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), rf"{WS}+", " "))


def escape_cell(cell: Column) -> Column:
    """A normalized cell that can't end a pipe table's cell: backslashes first, then pipes."""
    return F.replace(F.replace(normalize_cell(cell), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?:https?://|mma\.tw/)\S+", "")


def squeeze_blank_lines(text: Column) -> Column:
    """At most one blank line in a row, white space at the ends gone."""
    return trim_ws(F.regexp_replace(text, "\n{3,}", "\n\n"))


def yaml_escape(value: Column) -> Column:
    """For a double-quoted YAML scalar."""
    out = value
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def xml_escape(value: Column) -> Column:
    """XML 1.0 text: characters that it doesn't allow go, markup is escaped."""
    out = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def truncate(text: Column, limit: int = 60) -> Column:
    """Trimmed, and cut to ``limit`` characters with an ellipsis."""
    own = trim_ws(text)
    return F.when(F.length(own) <= limit, own).otherwise(F.concat(F.left(own, F.lit(limit)), F.lit("…")))


def title_from_frontmatter(text: Column) -> Column:
    """The ``title`` of a leading frontmatter block, null without one."""
    block = F.regexp_extract(text, r"\A---[ \t]*\n((?s:.*?))\n---[ \t]*(?:\n|\z)", 1)
    title = F.regexp_extract(block, r"(?m)^title:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(title, r"\A([\"'])(.*)\1\z", "$2")
    return F.when(bare != "", bare)


def body_after_frontmatter(text: Column) -> Column:
    """Without a leading frontmatter block; one that never ends is body."""
    return F.regexp_replace(text, r"\A---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|\z)", "")


def frontmatter(title: Column, description: Column, tags: Column, source: Column, published: str) -> Column:
    """The YAML block of rendered Markdown; ``published`` is a parameter, so that output is reproducible."""
    listed = F.array_join(F.transform(tags, lambda t: F.concat(F.lit('  - "'), yaml_escape(t), F.lit('"'))), "\n")
    block = F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(F.lit("tags:\n"), listed)).otherwise(F.lit("tags: []"))
    quote = lambda name, c: F.concat(F.lit(f'{name}: "'), yaml_escape(F.coalesce(c, F.lit(""))), F.lit('"'))
    return F.concat_ws("\n", F.lit("---"), quote("title", title), quote("description", description), F.lit(f'pubDate: "{published}"'), F.lit("draft: true"), block, quote("sourcePath", source), F.lit("---\n"))


def raw_markdown(text: Column, filename: Column, *, source: Column | None = None, published: str | None = None) -> Column:
    """Extracted text under its file name; with frontmatter where ``published`` is given."""
    parts: list[Column] = []
    if published is not None:
        parts.append(frontmatter(filename, F.lit("Raw extraction"), F.array().cast("array<string>"), source if source is not None else F.lit(""), published))
    parts += [F.concat(F.lit("# "), filename, F.lit("\n")), text]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def refined_markdown(title: Column, summary: Column, body: Column, tags: Column, filename: Column, *, source: Column | None = None, published: str | None = None, keep_empty: bool = False) -> Column:
    """A model's title, summary and body; missing parts are left out, empty ones too unless ``keep_empty``; a missing title is the file name."""
    name = F.coalesce(F.when(title != "", title), filename)
    given = lambda c: c.isNotNull() if keep_empty else c != ""
    parts: list[Column] = []
    if published is not None:
        parts.append(frontmatter(name, F.coalesce(summary, F.lit("")), tags, source if source is not None else F.lit(""), published))
    parts += [F.concat(F.lit("# "), name, F.lit("\n")), F.when(given(summary), F.concat(F.lit("> "), summary, F.lit("\n"))), F.when(given(body), body)]
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def render_extension_filter(name: Column, extensions: Sequence[str]) -> Column:
    """Whether a file name has one of ``extensions`` (with their dot), whatever its case."""
    return F.lower(F.regexp_extract(name, r"(?s)[^/]*?(\.[^./]*)?\z", 1)).isin(*extensions)
