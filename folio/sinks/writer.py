"""Files written by the executors, each atomically: a temporary file beside it, then a rename."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def write_atomically(path: str, data: bytes) -> None:
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_rows(df: DataFrame, *, path: str = "output", data: str = "data") -> DataFrame:
    """Writes ``data`` (binary) to ``path`` (on a file system that all executors share); adds ``write_error``, null where it worked.

    Rows without data or path are passed on. A task that runs again writes the
    same files again. The column ``data`` is dropped.
    """
    names = [c for c in df.columns if c != data]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors: list[str | None] = []
            for target, content in zip(batch.column(path).to_pylist(), batch.column(data).to_pylist()):
                error = None
                if target is not None and content is not None:
                    try:
                        write_atomically(target, content)
                    except OSError as e:
                        error = str(e)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(errors, pa.string())], [*names, "write_error"])

    return df.mapInArrow(run, f"{kinds}, write_error string")
