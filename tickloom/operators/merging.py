"""Keyed merges, latest rows, as-of look-ups, set operations on dates.

Where the order of arrival decides, rows carry it in a column (`seq`): nothing depends on the order of a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, those of `new` where both have the key (U6, U7, K9). `new` has a key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def append_unseen(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of `new` whose key `old` lacks, each key once."""
    return pick(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), keys, order)


def replace_range(old: DataFrame, new: DataFrame, gone: Column) -> DataFrame:
    """Delete and insert: what `gone` holds for leaves, `new` comes (U16)."""
    return old.where(~F.coalesce(gone, F.lit(False))).unionByName(new)


def correction_log(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row for each key of both in which any field changed, null-safely, with the changed names."""
    a = old.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields])
    b = new.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    return a.join(b, list(keys)).withColumn("changed", F.array_join(changed, ",")).where("changed <> ''")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, seen: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Join each left row to the right row of its key that was seen last, not after it.

    Both sides are one stream sorted by (key, time), and the last right row is carried forward: a sort, no
    join that grows with pairs. With `strict` a right row of the same time comes too late. Of right rows of
    one time the last in all columns counts.
    """
    carried = F.struct(F.col(seen), *[F.col(v) for v in values])
    a = left.withColumn("__at", F.col(at)).withColumn("__side", F.lit(0 if strict else 2)).withColumn("__hit", F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType))
    b = right.select(*keys, F.col(seen).alias("__at"), F.lit(1).alias("__side"), carried.alias("__hit"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", "__hit").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__hit", ignorenulls=True).over(w))
    return both.where("__side <> 1").select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in (seen, *values)])


def spine(days: DataFrame, rows: DataFrame, on: str, flag: str = "is_placeholder") -> DataFrame:
    """A row for each day of either side; days without a row are placeholders."""
    every = days.select(on).unionByName(rows.select(on)).distinct()
    return every.join(rows.withColumn("__has", F.lit(True)), on, "left").withColumn(flag, F.col("__has").isNull()).drop("__has")


def overlapping(df: DataFrame, first: str, last: str, start: Column, end: Column) -> DataFrame:
    """Intervals that meet [start, end]; an open end is its first day."""
    return df.where((F.col(first) <= end) & (F.coalesce(F.col(last), F.col(first)) >= start))


def by_day(df: DataFrame, first: str, last: str, day: str = "day", most: int = 366) -> DataFrame:
    """Each interval under each of its days (J17); a reversed or longer interval only under its first."""
    end = F.coalesce(F.col(last), F.col(first))
    ok = (end >= F.col(first)) & (F.datediff(end, F.col(first)) < most)
    return df.withColumn(day, F.explode(F.when(ok, F.sequence(F.col(first), end, F.expr("interval 1 day"))).otherwise(F.array(first))))
