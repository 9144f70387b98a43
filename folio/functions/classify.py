"""Which way a document's text was made - native, broken layout or scan - from measures of the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import trim_ws

NATIVE, BROKEN, SCANNED = "native", "layout_broken", "scanned"
LEAST_DENSITY, MOST_GARBAGE, MOST_SHORT, SHORT = 8, 0.05, 0.70, 10


def has_pipe_table(text: Column) -> Column:
    return text.rlike(r"\|.+\|.+\|")


def char_density(text: Column, pages: Column) -> Column:
    return F.length(trim_ws(text)) / F.greatest(pages, F.lit(1))


def garbage_ratio(text: Column) -> Column:
    """Share of specials and non-characters, U+FFFD among them."""
    return F.regexp_count(text, F.lit(r"[\x{FFF0}-\x{FFFF}]")) / F.greatest(F.length(text), F.lit(1))


def short_line_ratio(text: Column) -> Column:
    """Share of lines of at most ``SHORT`` characters among those that aren't blank."""
    lines = F.filter(F.transform(F.split(text, "\n"), trim_ws), lambda x: x != "")
    return F.size(F.filter(lines, lambda x: F.length(x) <= SHORT)) / F.greatest(F.size(lines), F.lit(1))


def decide(density: Column, garbage: Column, short: Column) -> Column:
    return F.when((density < LEAST_DENSITY) | (garbage >= MOST_GARBAGE), SCANNED).when(short > MOST_SHORT, BROKEN).otherwise(NATIVE)


def classify(text: Column, pages: Column, source: str = "text") -> Column:
    """Struct of the class and its measures, rounded to 1, 4 and 3 places; null text is a scan of one page without measures."""
    density, garbage, short = char_density(text, pages), garbage_ratio(text), short_line_ratio(text)
    found = F.struct(
        decide(density, garbage, short).alias("type"), F.greatest(pages, F.lit(1)).cast("int").alias("page_count"), F.round(density, 1).alias("char_density"),
        F.round(garbage, 4).alias("garbage_ratio"), F.round(short, 3).alias("short_line_ratio"), F.lit(source).alias("source"))
    none = F.struct(F.lit(SCANNED).alias("type"), F.lit(1).alias("page_count"), *[F.lit(None).cast("double").alias(x) for x in ("char_density", "garbage_ratio", "short_line_ratio")], F.lit(None).cast("string").alias("source"))
    return F.when(text.isNotNull(), found).otherwise(none)


def accepts_layout(text: Column, pages: Column) -> Column:
    """Whether a layout tool's text is good enough to be taken as native: 50 characters, and either 20 a page or a table."""
    return (F.length(text) >= 50) & ~((char_density(text, pages) < 20) & ~has_pipe_table(text))


def clean_layout(text: Column) -> Column:
    """A layout tool's Markdown: line-break tags are spaces, image lines and extra blank lines go."""
    out = F.regexp_replace(text, r"(?U)<br\s*/?>", " ")
    out = F.regexp_replace(out, r"(?dUm)^!\[image \d+\]\([^)]*\)\s*$", "")
    return trim_ws(F.regexp_replace(out, "\n{3,}", "\n\n"))
