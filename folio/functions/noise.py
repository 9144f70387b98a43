"""Noise in extracted text: notices, legal tails, links and blank lines, as one expression."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import rtrim_ws, squeeze_blank_lines, strip_urls

#: Where the legal tail of Taiwanese financial documents begins.
TAILS = (r"<投資人權益通知訊息[ >]", r"[～~]\s*總\s*公\s*司\s*訊\s*息\s*[～~]", r"依金融監督管理委員會保險局", r"謹慎理財.{0,20}信用至上", r"本商品由.{0,30}核准")
KEEP_RATIO = 0.3


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect: named groups, ``\\Z``, Unicode classes."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)


def strip_paragraphs(text: Column, patterns: Sequence[str] | None) -> Column:
    """From each match to the next blank line (which stays) or the end.

    One pass a pattern: a match that only arises where deleted parts meet
    stays, and a pattern that matches nothing but a paragraph's end deletes
    nothing (a loop would not end there).
    """
    for pattern in patterns or ():
        text = F.regexp_replace(text, rf"(?=(?:{java_pattern(pattern)}))(?s:.*?)(?=\n\n|\z)", "")
    return text


def truncate_tail(text: Column, patterns: Sequence[str] | None = None, keep_ratio: float = KEEP_RATIO) -> Column:
    """Up to the first match of any pattern - unless less than ``keep_ratio`` of the text would stay; no patterns: ``TAILS``."""
    either = "(?s)" + "|".join(f"(?:{java_pattern(p)})" for p in patterns or TAILS)
    kept = rtrim_ws(F.get(F.split(text, either, 2), F.lit(0)))
    enough = F.length(kept) / F.greatest(F.length(text), F.lit(1)) >= keep_ratio
    return F.when(text.rlike(either) & enough, kept).otherwise(text)


def clean_text(text: Column, *, tails: Sequence[str] | None = None, paragraphs: Sequence[str] | None = None, keep_ratio: float = KEEP_RATIO, urls: bool = True) -> Column:
    """Paragraphs, then the tail, then links, then blank lines."""
    out = truncate_tail(strip_paragraphs(text, paragraphs), tails, keep_ratio)
    return squeeze_blank_lines(strip_urls(out) if urls else out)
