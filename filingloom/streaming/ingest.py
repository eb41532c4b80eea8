"""Incremental, idempotent ingest: a stream of new rows into a table of latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from filingloom.operators.selection import latest_version


def landing_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Each key once within the watermark: what is delivered again is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, event_time: str, by: Sequence[str], value: str, length: str, delay: str) -> DataFrame:
    """Counts and sums per tumbling window, late rows within ``delay`` included."""
    w = F.window(event_time, length)
    return stream.withWatermark(event_time, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def ingest(stream: DataFrame, target: str, keys: Sequence[str], version: str, checkpoint: str, ties: Sequence[str] = ()) -> StreamingQuery:
    """Append each micro-batch's newest row per key under its batch number; of equally
    new rows the first by ``ties``.

    A batch that runs again overwrites its own folder, so the target never holds a
    batch twice; readers take ``current`` of it.
    """

    def save(batch: DataFrame, number: int) -> None:
        latest_version(batch, keys, version, ties).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> DataFrame:
    """The newest row per key over all batches."""
    return latest_version(spark.read.parquet(target), keys, version, [*ties, "batch"]).drop("batch")


def compacted(spark: SparkSession, target: str, into: str, keys: Sequence[str], version: str, ties: Sequence[str] = ()) -> None:
    """Write the newest rows as batch -1 of a new table ``into``, for readers and the next
    stream to go on from, so that what was replaced is not read for ever."""
    current(spark, target, keys, version, ties).write.mode("overwrite").parquet(f"{into}/batch=-1")
