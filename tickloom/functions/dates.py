"""Column functions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(d: Column) -> Column:
    """Year and ISO week, the year being that of the week's Thursday."""
    thursday = F.date_add(d, 4 - (F.weekday(d) + 1))
    return F.concat(F.year(thursday).cast("string"), F.lit("-"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def simple_week(d: Column) -> Column:
    """Year and seventh-day count of the year."""
    return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(F.ceil(F.dayofyear(d) / 7).cast("string"), 2, "0"))


def prior_month(d: Column, overflow: bool = False) -> Column:
    """A month earlier: clamped to that month's end, or running over into this one."""
    if not overflow:
        return F.add_months(d, -1)
    return F.date_add(F.trunc(F.add_months(d, -1), "month"), F.dayofmonth(d) - 1)


def parse_day(c: Column) -> Column:
    """Eight digits, dashes allowed, that are a day of the calendar; others are null."""
    bare = F.replace(F.trim(c), F.lit("-"), F.lit(""))
    return F.when(bare.rlike(r"^[0-9]{8}$"), F.try_to_date(bare, "yyyyMMdd"))


def business_days(first: Column, last: Column) -> Column:
    """Weekdays after `first` up to `last`; holidays aren't known."""
    whole = F.floor(F.datediff(last, first) / 7)
    rest = F.sequence(F.date_add(first, (whole * 7).cast("int") + 1), last)
    tail = F.when(F.pmod(F.datediff(last, first), F.lit(7)) > 0, F.size(F.filter(rest, lambda d: F.weekday(d) < 5))).otherwise(0)
    return F.when(last >= first, whole * 5 + tail).otherwise(0)


def add_business_days(d: Column, n: int) -> Column:
    """The n-th weekday after a day (F8)."""
    moved = F.when(F.weekday(d) >= 5, F.date_sub(d, F.weekday(d) - 4)).otherwise(d)
    place = F.weekday(moved) + n
    return F.date_add(moved, (F.floor(place / 5) * 7 + place % 5 - F.weekday(moved)).cast("int"))
