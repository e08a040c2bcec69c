"""Alias maps: symbols in one form, chains of aliases closed, and orders by a language's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.sources import scratch

#: Chains of up to two to this power are followed.
DOUBLINGS = 8


def us_symbol(c: Column) -> Column:
    """A symbol in capitals without `$` or `US:` before it; a share class after a dash comes after a dot."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^\$", ""), "^US:", "")
    return F.regexp_replace(bare, r"^([A-Z0-9]+)-([A-Z])$", "$1.$2")


def closed(aliases: DataFrame) -> DataFrame:
    """alias, canonical: every alias with the end of its chain (canonical of canonical), by doubling.

    An alias that is given several canonicals takes the smallest. Aliases that go round in a circle are an error.
    """
    steps = scratch.cut(aliases.where("alias IS NOT NULL AND canonical IS NOT NULL AND alias <> canonical").groupBy("alias").agg(F.min("canonical").alias("canonical")))
    for _ in range(DOUBLINGS):
        nxt = steps.select(F.col("alias").alias("canonical"), F.col("canonical").alias("further"))
        moved = steps.join(nxt, "canonical", "left")
        if moved.where("further IS NOT NULL").isEmpty():
            return steps
        if not moved.where("further = alias").isEmpty():
            break
        steps = scratch.cut(moved.select("alias", F.coalesce("further", "canonical").alias("canonical")))
    raise ValueError("aliases go round in a circle")


def canonical(df: DataFrame, aliases: DataFrame, column: str, into: str) -> DataFrame:
    """`df` with the end of the alias chain of a column, or the column itself, in `into`."""
    ends = aliases.select(F.col("alias").alias(column), F.col("canonical").alias("__end"))
    return df.join(ends, column, "left").withColumn(into, F.coalesce("__end", column)).drop("__end")


def in_order(names: Column, collation: str) -> Column:
    """An array of names sorted by the rules of a language, equal ones by their letters."""
    c = lambda x: F.collate(x, collation)
    return F.array_sort(names, lambda a, b: F.when(c(a) < c(b), -1).when(c(a) > c(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
