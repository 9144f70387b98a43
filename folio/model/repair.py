"""A model's answer as an object: parsed where it is JSON, mended where it nearly is, rescued where it isn't."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = "title string, summary string, refined_markdown string, tags array<string>, status string"
_TEXT = T.StringType()
ANSWER_TYPE = T.StructType([T.StructField("title", _TEXT), T.StructField("summary", _TEXT), T.StructField("refined_markdown", _TEXT), T.StructField("tags", T.ArrayType(_TEXT)), T.StructField("status", _TEXT)])
PARTIAL = "partial_recovery"
RESCUED = "JSON parse error — recovered raw content"


def unfenced(raw: str) -> str:
    s = raw.strip()
    for fence in ("```json", "```"):
        if s.startswith(fence):
            s = s[len(fence) :]
            break
    return s.removesuffix("```").strip()


def mended(s: str) -> str:
    """Without commas before a closing bracket; a text that doesn't end in one gets its string and brackets closed."""
    s = re.sub(r",\s*(?=[\]}])", "", s)
    if s.endswith(("}", "]")):
        return s
    if len(re.findall(r'(?<!\\)"', s)) % 2:
        s += '"'
    closers: list[str] = []
    quoted, before = False, ""
    for c in s:
        if c == '"' and before != "\\":
            quoted = not quoted
        elif not quoted and c in "{[":
            closers.append("}" if c == "{" else "]")
        elif not quoted and closers and c == closers[-1]:
            closers.pop()
        before = c
    return s + "".join(reversed(closers))


def repair(raw: str) -> Any:
    s = unfenced(raw)
    for attempt in (s, mended(s)):
        try:
            return json.loads(attempt)
        except json.JSONDecodeError:
            pass
    found = re.search(r'"refined_markdown"\s*:\s*"((?:[^"\\]|\\.)*)"', mended(s), re.I | re.S)
    return {"summary": RESCUED, "refined_markdown": found[1].replace("\\n", "\n") if found else raw, "status": PARTIAL}


def as_answer(value: Any) -> dict[str, Any]:
    """The fields of ``ANSWER``; an answer that isn't an object raises, fields of other types are null."""
    if not isinstance(value, dict):
        raise TypeError("the model's answer is not an object")
    text = lambda k: value[k] if isinstance(value.get(k), str) else None
    tags = [str(t) for t in value["tags"]] if isinstance(value.get("tags"), list) else None
    return {"title": text("title"), "summary": text("summary"), "refined_markdown": text("refined_markdown"), "tags": tags, "status": text("status")}


@F.pandas_udf(ANSWER_TYPE)
def repaired(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for r in raw:
        try:
            rows.append(as_answer(repair(r)) if r is not None else dict.fromkeys(("title", "summary", "refined_markdown", "tags", "status")))
        except TypeError:
            rows.append({"title": None, "summary": None, "refined_markdown": None, "tags": None, "status": "error"})
    return pd.DataFrame(rows, columns=["title", "summary", "refined_markdown", "tags", "status"])


def answer(raw: Column) -> Column:
    """Struct ``ANSWER`` of raw answers: valid objects are parsed in the JVM, only the others are mended in Python."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\A```(?:json)?\s*", ""), r"\s*```\z", "")
    valid = F.try_parse_json(bare)
    is_object = F.coalesce(F.schema_of_variant(valid).startswith("OBJECT"), F.lit(False))
    parsed = F.from_json(bare, ANSWER)
    return F.when(is_object, parsed).otherwise(repaired(F.when(~is_object, raw)))
