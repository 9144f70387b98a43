"""The shared folder, tokenizer files and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is unset and all tasks run on this machine (tests)
    a temporary folder is made; it goes when the process ends. Any other master
    without the setting is an error: parts would be scattered.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _local.get(context.applicationId)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        _local[context.applicationId] = base
    folder = f"{qualified(spark, base).rstrip('/')}/folio-{uuid.uuid4().hex}"
    for made in _working:
        made.append(folder)
    return folder


_working: list[list[str]] = []


@contextmanager
def working_folders(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders made inside once what needs them is written."""
    _working.append(made := [])
    try:
        yield
    finally:
        _working.remove(made)
        for folder in made:
            removed(spark, folder)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme; one without is on Spark's default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return own.replace("file:/", "file:///", 1) if own.startswith("file:/") and not own.startswith("file://") else own


def filesystem(uri: str):
    """File system and path of a URI with a scheme, for the workers' own files: what pyarrow knows, or any that fsspec has a driver for."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        import fsspec

        system, path = fsspec.core.url_to_fs(uri)
        return fs.PyFileSystem(fs.FSSpecHandler(system)), path


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one, wherever it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and lost executors cost nothing."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: Of an Arrow batch on its way to a Python worker: buffers of both processes grow to twice a batch or more.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Statements run inside hand their rows to Python in batches of about ``BATCH_BYTES``, whatever the length of texts; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Memo(dict):
    """A bounded memo of a function: two generations, the older one is dropped when the newer is full."""

    def __init__(self, fill: Callable, limit: int = 150_000) -> None:
        super().__init__()
        self.fill, self.limit, self.older = fill, limit, {}

    def __missing__(self, key: Hashable):
        value = self.older.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


#: 16 MB: the largest bit map that is broadcast, whatever it marks.
MAX_BITS = 1 << 27


def bit_map(wanted: DataFrame, column: str) -> tuple[Broadcast, int]:
    """A broadcast bit map (64 bits an integer) of ``xxhash64(column)`` and the logarithm of its size.

    About 16 bits for each row, at most ``MAX_BITS``: it thins tables where
    they lie; hits may be false, and are more often so once it is full. The
    driver sees the map's integers, no rows.
    """
    power = min(MAX_BITS.bit_length() - 1, max(10, int(16 * wanted.count()).bit_length()))
    spot = F.pmod(F.xxhash64(column), F.lit(1 << power))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))
    words = wanted.select(F.shiftright(spot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return wanted.sparkSession.sparkContext.broadcast(bits), power


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
