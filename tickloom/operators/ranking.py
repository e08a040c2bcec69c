"""Ranked lists, concentration and fair selection."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources import scratch


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Spark drops the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)


def concentration(df: DataFrame, day: str, code: str, amount: str, shares: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Of each day: codes with an amount above 0, their total, and what the largest 1, 3, 5 % of them hold (A1)."""
    live = df.where(F.col(amount) > 0)
    w = Window.partitionBy(day).orderBy(F.col(amount).desc(), code)
    ranked = live.withColumn("place", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(day)))
    k = {p: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p) / 100)) for p in shares}
    out = ranked.groupBy(day).agg(
        F.max("n").alias("n_codes"),
        F.sum(amount).alias("total"),
        *[F.max(k[p]).cast("long").alias(f"top{p}_count") for p in shares],
        *[F.sum(F.when(F.col("place") <= k[p], F.col(amount)).otherwise(0)).alias(f"top{p}_amount") for p in shares],
    )
    return out.withColumns({f"top{p}_pct": F.col(f"top{p}_amount") * 100.0 / F.col("total") for p in shares})


def warning(*pct: Column) -> Column:
    """Ladder on the largest of several percentiles."""
    top = F.greatest(*pct)
    return F.when(top >= 98, "danger").when(top >= 95, "warning").when(top >= 90, "warm").otherwise("normal")


def round_robin(df: DataFrame, queue: str, order: Sequence[Column], quota: int) -> DataFrame:
    """Heads of every queue first, then their seconds, up to a quota: no queue starves another."""
    turn = F.row_number().over(Window.partitionBy(queue).orderBy(*order))
    df = df.withColumn("turn", turn.cast("long")).where(F.col("turn") <= quota)
    place = F.row_number().over(Window.orderBy("turn", *order))
    return df.withColumn("place", place.cast("long")).where(F.col("place") <= quota)


#: Rows of a range in `priority_fair`, for each of its `first`.
RANGE_ROWS = 10_000


def priority_fair(df: DataFrame, queue: str, score: str, seq: str, weight: str, url: str, title: str, quota: int, first: int = 32) -> DataFrame:
    """What fair selection takes from queues: best heads first, at most `quota` of a queue, one of each url and title.

    Rows go by falling score, then queue, then `seq`, as long as their queue has taken less than its quota. A row that
    shares url or title with one taken replaces the first such one if its queue (its best row's `weight`) is heavier
    than that row, and is dropped otherwise; null and empty urls or titles are alike too. `place` orders the result.

    The selection is sequential, so rows are written in ranges of the order, of about `first` times RANGE_ROWS each, and
    one task goes over a range at a time: it holds a range and what is taken so far, which is the result, never all rows.
    """
    w = Window.partitionBy(queue).orderBy(F.col(score).desc(), seq)
    ranked = df.withColumn("__turn", F.row_number().over(w)).withColumn("__heavy", F.first(weight).over(w))
    names = [queue, "__turn", "__heavy", score, seq, weight, url, title]
    kinds = dict(df.dtypes)
    spark = df.sparkSession
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("top")).first()
    n = max(1, -(-size["n"] // (first * RANGE_ROWS)))
    path = f"{scratch.folder(spark)}/fair"
    order = [F.col(score).desc(), F.col(queue), F.col(seq)]
    line = ranked.select(*names).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    line.write.partitionBy("__range").parquet(path)
    line = spark.read.schema(line.schema).parquet(path)

    taken: dict = {}
    slots: list = []
    for k in range(n):
        held = spark.sparkContext.broadcast((taken, slots))
        rows = line.where(F.col("__range") == k).drop("__range").coalesce(1).sortWithinPartitions(*order)
        state = rows.mapInArrow(_fair_range(names, held, size["top"], quota), "taken binary, slots binary").first()
        if state is not None:
            changed, put = pickle.loads(state["taken"]), pickle.loads(state["slots"])
            taken = taken | changed
            slots = slots + [None] * (max([*put, -1]) + 1 - len(slots))
            for slot, row in put.items():
                slots[slot] = row
        held.unpersist()
    keys = spark.createDataFrame([(r[0], r[1]) for r in slots], f"__queue {kinds[queue]}, __at int")
    out = ranked.join(F.broadcast(keys), ranked[queue].eqNullSafe(keys["__queue"]) & (ranked["__turn"] == keys["__at"]), "left_semi").select(*df.columns)
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _fair_range(names: Sequence[str], held, top, quota: int):
    """Goes on with fair selection over one sorted range; gives the queues and slots that changed."""

    def select(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        taken, slots = dict(held.value[0]), list(held.value[1])
        changed, put = {}, {}
        holders: tuple[dict, dict] = ({}, {})

        def hold(slot: int, row: tuple, on: bool) -> None:
            for by, key in zip(holders, (row[6] or "", row[7] or "")):
                at = by.setdefault(key, set())
                at.add(slot) if on else at.discard(slot)

        for slot, row in enumerate(slots):
            hold(slot, row, True)
        # no queue is heavier than the slots of the largest weight: as long as none before them may change, rows alike go, whatever comes
        dead = list(itertools.takewhile(lambda r: r[5] == top, slots))
        dead = [pa.array(sorted({r[i] or "" for r in dead}), pa.string()) for i in (6, 7)]
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            alike = [pc.is_in(pc.fill_null(batch.column(c).cast(pa.string()), ""), value_set=keys) for c, keys in zip(names[6:], dead)]
            batch = batch.filter(pc.invert(pc.or_(*alike)))
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                q = row[0]
                if taken.get(q, 0) >= quota:
                    continue
                alike = holders[0].get(row[6] or "", set()) | holders[1].get(row[7] or "", set())
                slot = min(alike, default=len(slots))
                if alike:
                    if row[2] <= slots[slot][5]:
                        continue
                    hold(slot, slots[slot], False)
                    slots[slot] = row
                else:
                    slots.append(row)
                put[slot] = row
                hold(slot, row, True)
                changed[q] = taken[q] = taken.get(q, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x)], pa.binary()) for x in (changed, put)], names=["taken", "slots"])

    return select


def balanced(df: DataFrame, key: str, positive: str, order: Sequence[Column], up: int, down: int, limit: int) -> DataFrame:
    """Of each key up to `limit` rows: `up` positive and `down` others, what one side lacks filled from the other.

    No side can give more than `limit`, so Spark drops what lies beyond before the rows are counted.
    """
    w = Window.partitionBy(key, positive).orderBy(*order)
    rows = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit)
    side, c = Window.partitionBy(key), F.col
    rows = rows.withColumns({"__np": F.count_if(c(positive)).over(side), "__nn": F.count_if(~c(positive)).over(side)})
    negative = F.least(F.lit(down), "__nn")
    wanted = F.least(F.when(c("__nn") == 0, limit).otherwise(up + down - negative), "__np")
    taken = wanted + F.greatest(F.lit(0), F.least(limit - wanted - negative, c("__np") - wanted))
    rows = rows.where(c("__rn") <= F.when(c(positive), taken).otherwise(F.least(c("__nn"), limit - taken)))
    return rows.drop("__rn", "__np", "__nn")
