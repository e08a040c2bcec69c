"""Incremental feeds in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import merging
from tickloom.sources import versions


def unseen(stream: DataFrame, keys: list[str], time: str, late: str = "7 days") -> DataFrame:
    """Each key once, as it first comes (B2, U9); state for keys older than `late` is given up."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, width: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows, emitted when a window is over."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def upsert_sink(stream: DataFrame, path: str, keys: list[str], order: list, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep a keyed table in versions (sources/versions.py): each batch replaces the rows of its keys.

    Only the buckets of a batch's keys are rewritten. A batch that runs again after a failure finds its number in the
    manifest, or, if it died before, the version before it. The version before the last stays for those who are
    reading it; older ones go.
    """

    def write(batch: DataFrame, number: int) -> None:
        versions.upsert(merging.pick(batch, keys, order), path, keys, buckets, batch=(checkpoint, number))
        versions.forget(batch.sparkSession, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
