"""Ranks inside a moving sample of days, from day histograms that are added up and taken away.

For each row: how many samples of its key lie in the days up to its own, and how many of them are at most its value.
Rows are counted by (key, value, day) first and swept in the order of values, with one counter a day; a sample of 30
days is then a sum of 30 counters, whatever it holds. A key of very many values is cut into slices of values; a slice
starts with the day histogram of the slices below it, so no key is swept by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a key that one task sweeps, about; and slices of a larger key.
SLICE_ROWS = 200_000
SLICES = 64


def ranks_in_days(df: DataFrame, key: str, value: str, day: str, sample: str, days: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """key, value, day, n, at_most: distinct rows of `df` with the number of samples (rows whose `sample` is true) of
    the same key in the `days` days that end with theirs, and of those at most their value.

    `key` is a string and `day` a date. Rows whose key, value or day is null aren't ranked; a null `sample` is false.
    """
    named = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.datediff(day, F.lit("1970-01-01").cast("date")).alias("d"), F.coalesce(F.col(sample).cast("int"), F.lit(0)).alias("c"))
    counts = named.where("k IS NOT NULL AND v IS NOT NULL AND d IS NOT NULL").groupBy("k", "v", "d").agg(F.sum("c").alias("c"))
    window = Window.partitionBy("k").orderBy("d").rangeBetween(1 - days, 0)
    totals = counts.groupBy("k", "d").agg(F.sum("c").alias("c")).select("k", "d", F.sum("c").over(window).alias("n"))

    # a join on a key of many rows: Spark splits the larger side where it is skewed
    edges = F.percentile_approx("v", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), F.lit(10_000))
    cuts = counts.groupBy("k").agg(F.when(F.count(F.lit(1)) > slice_rows, edges).alias("edges"))
    sliced = counts.join(cuts, "k").withColumn("s", F.when(F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col("v")))))
    whole = sliced.where("edges IS NOT NULL").groupBy("k", "d", "s").agg(F.sum("c").alias("c"))
    spread = whole.groupBy("k", "d").agg(F.collect_list(F.struct("s", "c")).alias("h"))  # at most SLICES numbers
    below = F.explode(F.transform(F.sequence(F.lit(1), F.lit(SLICES - 1)), lambda s: F.struct(s.alias("s"), F.reduce(F.filter("h", lambda x: x["s"] < s), F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("c"))))
    carried = spread.select("k", "d", below.alias("b")).select("k", "b.s", F.lit(None).cast("double").alias("v"), "d", "b.c").where("c > 0")
    dealt = sliced.select("k", "s", "v", "d", "c").unionByName(carried).repartition("k", "s").sortWithinPartitions("k", "s", F.col("v").asc_nulls_first(), "d")
    span = counts.agg(F.min("d"), F.max("d")).first()
    first, width = (span[0] or 0), (span[1] or 0) - (span[0] or 0) + 1

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = np.zeros(width, np.int64), None, []
        same: list[tuple] = []

        def flush() -> None:
            # samples of equal value count for each other
            for k, _, v, d, c in same:
                held[d - first] += c
            out.extend((k, v, d, int(held[max(0, d - first + 1 - days) : d - first + 1].sum())) for k, _, v, d, _ in same if v is not None)
            same.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if same and row[:3] != same[0][:3]:
                    flush()
                if row[:2] != at:
                    held[:] = 0
                    at = row[:2]
                same.append(row)
            if len(out) >= 20_000:
                yield _ranked(out)
                out.clear()
        flush()
        yield _ranked(out)

    found = dealt.mapInArrow(sweep, "k string, v double, d int, at_most long").join(totals, ["k", "d"])
    return found.select(F.col("k").alias(key), F.col("v").alias(value), F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")).alias(day), "n", "at_most")


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.int64()))], names=["k", "v", "d", "at_most"])
