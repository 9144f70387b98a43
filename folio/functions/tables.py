"""Pipe tables from ``array<array<string>>``, in the styles of the formats they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import escape_cell, let, normalize_cell


def padded(row: Column, width: Column) -> Column:
    """A row of ``width`` cells; missing ones are empty, further ones go."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(row, i), F.lit("")))


def widest(rows: Column) -> Column:
    """Cells of the longest row, 0 without rows."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def cells(row: Column) -> Column:
    return F.transform(row, escape_cell)


def spaced(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))


def dashes(width: Column) -> Column:
    return spaced(F.array_repeat(F.lit("---"), width.cast("int")))


def compact_table(rows: Column, header: Column | None = None) -> Column:
    """``|a|b|``, blank cells a space, as wide as the widest row; without a header the first row is it, an all-blank one alone is ''."""
    given = F.coalesce(F.size(header), F.lit(0)) > 0 if header is not None else F.lit(False)
    top = F.when(given, header).otherwise(F.get(rows, F.lit(0))) if header is not None else F.get(rows, F.lit(0))
    data = F.when(given, F.coalesce(rows, F.array())).otherwise(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))))

    def made(top: Column, data: Column, width: Column) -> Column:
        def line(row: Column) -> Column:
            shown = let(cells(row), lambda own: F.transform(padded(own, width), lambda c: F.when(c == "", " ").otherwise(c)))
            return F.concat(F.lit("|"), F.array_join(shown, "|"), F.lit("|"))

        blank = (F.size(data) == 0) & F.forall(top, lambda c: normalize_cell(c) == "")
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), "|"), F.lit("|"))
        body = F.array_join(F.concat(F.array(line(top), rule), F.transform(data, line)), "\n")
        return F.when(top.isNull() | (width < 1) | blank, "").otherwise(body)

    return let(F.struct(top.alias("top"), data.alias("data")), lambda t: let(F.greatest(F.size(t["top"]), widest(t["data"])), lambda width: made(t["top"], t["data"], width)))


def document_table(rows: Column) -> Column:
    """Spaced cells; a blank header goes on top where every cell of the first row is empty or an integer."""
    width = widest(rows)
    lines = F.transform(rows, lambda r: spaced(padded(cells(r), width)))
    numbers = F.forall(F.get(rows, F.lit(0)), lambda c: normalize_cell(c).rlike(r"(?U)^(?:-*\d+)?$"))
    blank = spaced(F.array_repeat(F.lit(""), width.cast("int")))
    with_blank = F.concat(F.array(blank, dashes(width)), lines)
    plain = F.concat(F.slice(lines, 1, 1), F.array(dashes(width)), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))
    return F.when(F.coalesce(width, F.lit(0)) < 1, "").otherwise(F.array_join(F.when(numbers, with_blank).otherwise(plain), "\n"))


def slide_table(rows: Column) -> Column:
    """Spaced cells, rows as they are; the first row is the header and gives the number of columns."""
    lines = F.transform(rows, lambda r: spaced(cells(r)))
    rule = dashes(F.size(F.get(rows, F.lit(0))))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n"))


def sheet_lines(rows: Column) -> Column:
    """Header, rule and data lines of a sheet: spaced, padded and cut to the header's width."""
    width = F.size(F.get(rows, F.lit(0)))
    lines = F.transform(rows, lambda r: spaced(padded(cells(r), width)))
    return F.concat(F.slice(lines, 1, 1), F.array(dashes(width)), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))


def sheet_table(rows: Column) -> Column:
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "").otherwise(F.array_join(sheet_lines(rows), "\n"))


def budgeted_sheet(rows: Column, budget: int = 8000) -> Column:
    """Struct (markdown, total, shown): the longest run of rows whose table has at most ``budget`` characters, with a note where some are left out.

    A table's length is its lines' lengths plus one each: a running sum, no search.
    """
    lines = sheet_lines(rows)
    total = F.size(rows) - 1
    sizes = F.transform(lines, lambda x: F.length(x) + 1)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("fit"))
    fits = F.aggregate(sizes, start, lambda a, n: F.struct((a["used"] + n).alias("used"), F.when(a["used"] + n - 1 <= budget, a["fit"] + 1).otherwise(a["fit"]).alias("fit")))["fit"]
    shown = F.greatest(fits - 2, F.lit(0))
    cut = F.left(F.array_join(F.slice(lines, 1, shown + 2), "\n"), F.lit(budget))
    note = F.format_string("\n\n(truncated — %d rows shown of %d)", shown, total)
    whole = F.struct(F.array_join(lines, "\n").alias("markdown"), total.alias("total"), total.alias("shown"))
    part = F.struct(F.concat(cut, note).alias("markdown"), total.alias("total"), shown.alias("shown"))
    none = F.struct(F.lit("").alias("markdown"), F.lit(0).alias("total"), F.lit(0).alias("shown"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, none).when(fits == F.size(lines), whole).otherwise(part)
