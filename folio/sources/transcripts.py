"""Chat transcripts in JSON lines: blocks as rows, tools resolved by a join, turns and sessions by ordered aggregates.

``blocks`` parses lines; everything after it is relational, so that a session
may be spread over any number of tasks. ``render_transcript`` applies the same
rules to one file at hand.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone, tzinfo
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.relations import resolve_tools

BLOCKS = "line long, session string, role string, ts string, block int, kind string, body string, tool_id string, tool_name string"
RULE = "\n\n---\n\n"
LIMIT = 60
FIRST = ("file_path", "command", "url", "prompt")


def shortened(value: object) -> str:
    text = str(value).strip()
    return text if len(text) <= LIMIT else text[:LIMIT] + "…"


def tool_line(block: dict[str, Any]) -> str:
    """A tool's name and its main argument: a known key, else the first string in the order given."""
    name, given = block.get("name", "Tool"), block.get("input")
    if isinstance(given, dict):
        key = next((k for k in FIRST if k in given), None) or next((k for k, v in given.items() if isinstance(v, str)), None)
        if key is not None:
            return f"🔧 {name}: {shortened(given[key])}"
    return f"🔧 {name}"


def result_text(block: dict[str, Any]) -> str:
    content = block.get("content", "")
    if isinstance(content, list):
        parts = (str(x.get("text", "")).strip() for x in content if isinstance(x, dict) and x.get("type") == "text")
        return "\n".join(p for p in parts if p)
    return content.strip() if isinstance(content, str) else ""


def folded(title: str, body: str) -> str:
    return f"<details><summary>{title}</summary>\n\n{body}\n\n</details>"


def entry_blocks(line: str) -> Iterator[tuple]:
    """(session, role, ts, block, kind, body, tool id, tool name) of one line; lines that aren't turns give none, malformed ones too."""
    try:
        entry = json.loads(line)
    except ValueError:
        return
    if not isinstance(entry, dict) or (role := entry.get("type")) not in ("user", "assistant"):
        return
    message = entry.get("message") if isinstance(entry.get("message"), dict) else {}
    session, ts = str(entry.get("sessionId", "") or ""), entry.get("timestamp")
    head = (session, role, ts if isinstance(ts, str) else None)
    content = message.get("content", "")
    yield (*head, -1, "turn", None, None, None)
    if isinstance(content, str):
        content = [{"type": "text", "text": content}] if role == "user" else []
    for i, block in enumerate(content if isinstance(content, list) else []):
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text" and (text := str(block.get("text") or "").strip()):
            yield (*head, i, "text", text, None, None)
        elif kind == "tool_result" and role == "user":
            yield (*head, i, "tool_result", result_text(block), str(block.get("tool_use_id", "")), None)
        elif kind == "tool_use" and role == "assistant":
            yield (*head, i, "tool_use", tool_line(block), str(block.get("id", "") or ""), str(block.get("name", "tool")))
        elif kind == "thinking" and role == "assistant" and (text := str(block.get("thinking") or "").strip()):
            yield (*head, i, "thinking", text, None, None)


def blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``BLOCKS`` from ``lines`` (keys, line, value); a row of kind 'turn' stands for each turn itself."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name in keys)
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
    names = BLOCKS.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (line, value) in enumerate(zip(batch.column("line").to_pylist(), batch.column("value").to_pylist())):
                own = [(line, *b) for b in entry_blocks(value or "")]
                at += [i] * len(own)
                rows += own
            own_keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*own_keys, *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], [*keys, *names])

    return lines.select(*keys, "line", "value").mapInArrow(run, f"{kinds}, {BLOCKS}" if kinds else BLOCKS)


def clock(ts: Column, pattern: str) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(ts), pattern), F.lit(""))


def turns(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row per turn with its Markdown: keys, session, line, role, ts, markdown."""
    own = [*keys, "session"]
    tools = parsed.where("kind = 'tool_use' and tool_id <> ''").select(*own, "tool_id", F.col("tool_name").alias("name"), F.struct("line", "block").alias("seq"))
    results = parsed.where("kind = 'tool_result' and body <> ''").drop("tool_name")
    named = resolve_tools(results, tools, keys=[*own, "tool_id"])
    opened = lambda title: F.concat(F.lit("<details><summary>"), title, F.lit("</summary>\n\n"), F.col("body"), F.lit("\n\n</details>"))
    shown = named.select(*own, "line", "role", "ts", "block", opened(F.concat(F.lit("tool_result ("), F.col("tool_name"), F.lit(")"))).alias("body"))
    time = clock(F.col("ts"), "HH:mm")
    name = F.when(F.col("role") == "user", "**User**").otherwise("**Assistant**")
    header = F.when(time != "", F.concat(name, F.lit(" · "), time)).otherwise(name)
    rest = parsed.where("kind in ('turn', 'text', 'tool_use', 'thinking')").select(*own, "line", "role", "ts", "block", F.when(F.col("kind") == "turn", header).when(F.col("kind") == "thinking", opened(F.lit("thinking"))).otherwise(F.col("body")).alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "body")))
    return rest.unionByName(shown).groupBy(*own, "line", "role", "ts").agg(F.array_join(F.transform(ordered, lambda b: b["body"]), "\n\n").alias("markdown"))


def sessions(rendered: DataFrame, *keys: str) -> DataFrame:
    """A row per session: keys, session, first (its first line), markdown with the date of its first turn."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "markdown")))
    grouped = rendered.groupBy(*keys, "session").agg(F.min("line").alias("first"), F.min_by("ts", "line").alias("ts"), F.array_join(F.transform(ordered, lambda t: t["markdown"]), RULE).alias("body"))
    name = F.when(F.col("session") == "", "unknown").otherwise(F.left("session", F.lit(8)))
    date = clock(F.col("ts"), "yyyy-MM-dd")
    head = F.concat(F.lit("## Session "), name, F.lit("\n"), F.when(date != "", F.concat(F.lit("_"), date, F.lit("_\n"))).otherwise(""))
    return grouped.select(*keys, "session", "first", F.concat(head, F.lit("\n"), F.col("body")).alias("markdown"))


def transcripts(found: DataFrame, *keys: str) -> DataFrame:
    """A row per file: sessions in order of their first line."""
    ordered = F.array_sort(F.collect_list(F.struct("first", "markdown")))
    return found.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["markdown"]), RULE).alias("markdown"))


def moment(ts: object, zone: tzinfo | None) -> datetime | None:
    try:
        return datetime.fromisoformat(ts.replace("Z", "+00:00")).astimezone(zone) if isinstance(ts, str) and ts else None
    except ValueError:
        return None


def render_transcript(content: bytes, warn, zone: tzinfo | None = timezone.utc) -> str:
    """A transcript file as Markdown; times are shown in ``zone``."""
    found: dict[str, list[list[tuple]]] = {}
    for line in content.decode("utf-8", "replace").split("\n"):
        if own := list(entry_blocks(line)) if line.strip() else []:
            found.setdefault(own[0][0], []).append(own)
    if not found:
        warn("no turns in the transcript")
    out = []
    for session, entries in found.items():
        names = {b[6]: b[7] for own in entries for b in own if b[4] == "tool_use" and b[6]}
        shown = []
        for own in entries:
            role, at = own[0][1], moment(own[0][2], zone)
            parts = [("**User**" if role == "user" else "**Assistant**") + (f" · {at:%H:%M}" if at else "")]
            for b in own[1:]:
                if b[4] == "tool_result":
                    parts += [folded(f"tool_result ({names.get(b[6], 'tool')})", b[5])] if b[5] else []
                else:
                    parts.append(folded("thinking", b[5]) if b[4] == "thinking" else b[5])
            shown.append("\n\n".join(parts))
        date = moment(entries[0][0][2], zone)
        out.append("\n".join([f"## Session {session[:8] or 'unknown'}", *([f"_{date:%Y-%m-%d}_"] if date else []), "", RULE.join(shown)]))
    return RULE.join(out)
