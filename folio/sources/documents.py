"""Extension dispatch: bytes of files to text, warnings and status, one pass over the files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from folio.sources import archives, pdf
from folio.sources.transcripts import render_transcript

Reader = Callable[[bytes, archives.Warn], str]

READERS: dict[str, Reader] = {
    ".txt": archives.decoded, ".md": archives.decoded, ".csv": archives.csv_text, ".xlsx": archives.xlsx, ".xls": archives.xls, ".docx": archives.docx, ".pptx": archives.pptx, ".dxf": archives.dxf,
    ".epub": archives.epub, ".numbers": archives.numbers, ".key": archives.keynote, ".pages": archives.pages, ".jsonl": render_transcript, ".doc": archives.legacy(".doc"), ".ppt": archives.legacy(".ppt"), ".pdf": pdf.pdf_text,
}
#: Formats that fall back to the external converter where their reader fails or finds nothing.
FALLBACKS = {".docx": archives.legacy(".docx")}


def read_one(ext: str | None, content: bytes, password: str | None = None) -> tuple[str, list[str]]:
    """Text and warnings of one file; a failure is a warning and an empty text."""
    warnings: list[str] = []
    reader = READERS.get((ext or "").lower())
    if reader is None:
        return "", [f"unsupported file type: {ext}"]
    if ext.lower() == ".pdf":
        reader = partial(reader, password=password)
    text = ""
    for attempt in (reader, FALLBACKS.get(ext.lower())):
        if attempt and not text:
            try:
                text = attempt(content, warnings.append)
            except Exception as e:  # noqa: BLE001 - a broken file must not end the job; its row says why
                warnings.append(f"{type(e).__name__}: {e}")
    return text, warnings


def with_text(files: DataFrame, *, password: str | None = None) -> DataFrame:
    """``files`` (ext, content, ...) without their content, with ``text`` and ``warnings``; a task holds one file's text at a time."""
    names = [c for c in files.columns if c != "content"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_one(e, c or b"", password) for e, c in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist())]
            columns = [batch.column(c) for c in names] + [pa.array([t for t, _ in found], pa.string()), pa.array([w for _, w in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "text", "warnings"])

    return files.mapInArrow(run, f"{kinds}, text string, warnings array<string>")
