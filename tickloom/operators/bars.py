"""Bars within trading sessions from single ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: First and last minute (not included) of the day's sessions.
SESSIONS = [(9 * 60 + 30, 11 * 60 + 30), (13 * 60, 15 * 60)]


def session_bars(ticks: DataFrame, minutes: int, code: str = "code", at: str = "at", price: str = "price", order: str = "id") -> DataFrame:
    """code, day, slot, session, open, high, low, close, n, missing: bars of `minutes` from ticks (code, at, price, id).

    Slots are counted from the start of a session, so no bar spans the break; ticks outside sessions are left out.
    `missing` is the number of slots without a tick since the bar before, or since the session began: bars of one
    session only follow each other, and none is made up.
    """
    minute = F.hour(at) * 60 + F.minute(at)
    session, begin = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(SESSIONS))):
        inside = (minute >= a) & (minute < b)
        session, begin = F.when(inside, i).otherwise(session), F.when(inside, a).otherwise(begin)
    rows = ticks.select(F.col(code).alias("code"), F.to_date(at).alias("day"), session.alias("session"), F.floor((minute - begin) / minutes).cast("int").alias("k"), begin.alias("begin"), F.col(price).alias("price"), F.struct(F.col(at), F.col(order)).alias("seq"))
    bars = rows.where("session IS NOT NULL").groupBy("code", "day", "session", "begin", "k").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count(F.lit(1)).alias("n")
    )
    before = F.lag("k").over(Window.partitionBy("code", "day", "session").orderBy("k"))
    slot = F.to_timestamp("day") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("begin") + F.col("k") * minutes)
    return bars.select("code", "day", slot.alias("slot"), "session", "open", "high", "low", "close", "n", (F.col("k") - F.coalesce(before, F.lit(-1)) - 1).alias("missing"))


def with_enough(bars: DataFrame, others: DataFrame, least: int = 10, key: str = "code") -> DataFrame:
    """Bars of the keys that have at least `least` rows in both tables."""
    enough = lambda df: df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
    return bars.join(enough(bars), key, "left_semi").join(enough(others), key, "left_semi")


def one_of_each_time(candles: DataFrame, switch: str = "14:30") -> DataFrame:
    """Of candles (code, slot, period, ...) of each code's last day one for each time: the preferred period, which is 5
    minutes after `switch` and 15 before, else the shortest that is there (A20)."""
    last = Window.partitionBy("code")
    rows = candles.withColumn("__day", F.max(F.to_date("slot")).over(last)).where(F.to_date("slot") == F.col("__day")).drop("__day")
    wanted = F.when(F.date_format("slot", "HH:mm") > switch, 5).otherwise(15)
    place = F.row_number().over(Window.partitionBy("code", "slot").orderBy(F.col("period") != wanted, "period"))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
