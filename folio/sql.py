"""The operators as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from folio.functions import markup, urls
from folio.functions.noise import KEEP_RATIO, TAILS, java_pattern
from folio.functions.pii import GATE, PATTERNS
from folio.model.repair import repaired
from folio.session import ship


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> list[str]:
    """Registers SQL functions - expressions where the JVM can do it - and returns their names."""
    ship(spark)
    space = quoted(r"(?U)\s+\z|(?U)\A\s+")
    masked = "t"
    for _, pattern, mask in PATTERNS:
        masked = f"regexp_replace({masked}, {quoted(pattern)}, {quoted(mask)})"
    tails = quoted("(?s)" + "|".join(f"(?:{java_pattern(p)})" for p in TAILS))
    tail_end = quoted(r"(?U)\s+\z")
    kept = f"regexp_replace(get(split(t, {tails}, 2), 0), {tail_end}, '')"
    cell = f"trim(regexp_replace(coalesce(t, ''), {quoted(chr(40) + '?U' + chr(41) + chr(92) + 's+')}, ' '))"
    macros = {
        "folio_trim": f"regexp_replace(t, {space}, '')",
        "folio_normalize_cell": cell,
        "folio_escape_cell": f"replace(replace({cell}, {quoted(chr(92))}, {quoted(chr(92) * 2)}), '|', {quoted(chr(92) + '|')})",
        "folio_strip_urls": f"regexp_replace(t, {quoted(r'(?U)(?:https?://|mma[.]tw/)\S+')}, '')",
        "folio_redact": f"case when t rlike {quoted(GATE)} then {masked} else t end",
        "folio_truncate_tail": f"case when t rlike {tails} and length({kept}) / greatest(length(t), 1) >= {KEEP_RATIO} then {kept} else t end",
        "folio_has_pipe_table": f"t rlike {quoted(r'[|].+[|].+[|]')}",
    }
    for name, body in macros.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURN {body}")
    functions = {"folio_markdown_to_xhtml": markup.markdown_to_xhtml, "folio_markdown_to_html": markup.markdown_to_html, "folio_url_allowed": urls.url_allowed, "folio_repair_json": repaired}
    for name, function in functions.items():
        spark.udf.register(name, function)
    return [*macros, *functions]
