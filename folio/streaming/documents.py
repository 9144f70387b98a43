"""The stateless operators over a stream of files or records, and sessions of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folio.functions import classify, noise, pii
from folio.sources.documents import with_text
from folio.sources.files import file_rows

FILES = StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")


def file_stream(spark: SparkSession, folder: str, *, files_a_trigger: int = 1000) -> DataFrame:
    """New files of a folder as they arrive, with their text and warnings."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_a_trigger).load(folder)
    return with_text(file_rows(found).select("path", "filename", "stem", "ext", "length", "content"))


def profiled(docs: DataFrame) -> DataFrame:
    """Cleaned and masked text with its class and counts: row by row, so a stream needs no state."""
    cleaned = docs.withColumn("text", noise.clean_text(F.col("text")))
    masked = pii.with_redaction(cleaned, "text", redacted="redacted", counts="pii")
    return masked.withColumn("class", classify.classify(F.col("redacted"), F.lit(1)))


def session_counts(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions per key: windows that close after ``gap`` without an event; state is dropped ``late`` after."""
    windows = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first"))
    return windows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "first")


def to_table(stream: DataFrame, folder: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Parquet files with exactly-once commits, as far as there is input now."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
