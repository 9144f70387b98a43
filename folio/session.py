"""Helpers for a Spark session that runs this library."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever the driver found it; once a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="folio-ship-")) / "folio-library.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are cores: small tables in one row group.

    Larger tables have more partitions than that and are left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


#: Characters of results that a Python worker gathers before it hands them on.
SLICE_CHARS = 1 << 20


def in_slices(f: Callable[[str | None], tuple], column: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step for ``mapInArrow``: ``column`` gives way to strings ``names`` that ``f`` makes of it.

    Results leave every ``SLICE_CHARS``, or with the text that exceeds them, so a worker holds
    a batch as it came (Spark bounds its bytes) and no lists of all its texts and results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [n for n in batch.schema.names if n != column]
            texts, start, size, made = batch.column(column), 0, 0, []
            for end in range(1, len(texts) + 1):
                made.append(f(texts[end - 1].as_py()))
                size += sum(len(x) for x in made[-1] if x)
                if size >= SLICE_CHARS or end == len(texts):
                    results = [pa.array([m[i] for m in made], pa.string()) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(start, end - start) for n in rest), *results], [*rest, *names])
                    start, size, made = end, 0, []

    return run


def of_texts(df: DataFrame, column: str, names: list[str], f: Callable[[str | None], tuple]) -> DataFrame:
    """``df`` with strings ``names`` that ``f`` makes of ``column``, instead of it, in slices of little memory."""
    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name != column]
    return df.mapInArrow(in_slices(f, column, names), ", ".join([*kinds, *(f"`{n}` string" for n in names)]))
