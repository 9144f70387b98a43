"""Masking of personal data in Taiwanese formats, most specific first, and counts of what was masked."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name, pattern and replacement, in the order in which they apply.
PATTERNS: tuple[tuple[str, str, str], ...] = (
    ("credit_card", r"(?U)\b(\d{4})[\s-]?\d{4}[\s-]?\d{4}[\s-]?(\d{4})\b", "$1-****-****-$2"),
    ("national_id", r"(?U)\b([A-Z][12]\d{3})\d{5}\b", "$1****"),
    ("mobile", r"(?U)\b(09\d{2})[\s-]?\d{3}[\s-]?\d{3}\b", "$1-***-***"),
    ("landline", r"(?U)\b(0[2-9]\d?)[\s-]\d{3,4}[\s-]\d{4}\b", "$1-****-****"),
    ("business_id", r"(?U)(?<!\d)(\d{4})\d{4}(?!\d)", "$1****"),
)
#: No pattern matches where this doesn't: every kind has four digits in a row.
GATE = r"(?U)\d{4}"


def enabled(names: Collection[str] | None) -> list[tuple[str, str, str]]:
    return [p for p in PATTERNS if names is None or p[0] in names]


def redact(text: Column, names: Collection[str] | None = None) -> Column:
    """``text`` with all kinds (or those named) masked."""
    out = text
    for _, pattern, mask in enabled(names):
        out = F.regexp_replace(out, pattern, mask)
    return F.when(text.rlike(GATE), out).otherwise(text)


def with_redaction(df: DataFrame, column: str, *, redacted: str, counts: str, names: Collection[str] | None = None) -> DataFrame:
    """Adds the masked text and a struct of counts by kind and in total, counted stage by stage on what was masked so far.

    Every stage is a projection of its own, so no pattern runs twice; texts
    without a run of four digits skip them all.
    """
    own = "__folio_pii"
    out = df.withColumn(f"{own}_0", F.when(F.col(column).rlike(GATE), F.col(column)))
    stages = enabled(names)
    for i, (name, pattern, mask) in enumerate(stages):
        before = F.col(f"{own}_{i}")
        out = out.withColumns({f"{own}_{i + 1}": F.regexp_replace(before, pattern, mask), f"{own}_n_{name}": F.coalesce(F.regexp_count(before, F.lit(pattern)), F.lit(0))})
    each = [F.col(f"{own}_n_{name}").alias(name) for name, _, _ in stages]
    total = sum((F.col(f"{own}_n_{name}") for name, _, _ in stages), F.lit(0))
    out = out.withColumns({redacted: F.coalesce(F.col(f"{own}_{len(stages)}"), F.col(column)), counts: F.struct(*each, total.alias("total"))})
    return out.drop(*[f"{own}_{i}" for i in range(len(stages) + 1)], *[f"{own}_n_{name}" for name, _, _ in stages])
