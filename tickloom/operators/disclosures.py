"""Disclosed scores: one row for each identity, the most complete first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import text


def identity(value: Column, complete: Column, run: Column) -> Column:
    """What makes two disclosures the same, as canonical JSON: fields by name, absent ones as null."""
    return F.to_json(F.struct(complete.alias("complete"), run.alias("run"), value.alias("value")), {"ignoreNullFields": "false"})


def run_key(df: DataFrame, run: str) -> Column:
    """The fields of a run as slugs in their order, `none` for what lacks."""
    fields = [f.name for f in df.schema[run].dataType.fields]
    slug = lambda c: F.coalesce(F.nullif(text.slug(c.cast("string")), F.lit("")), F.lit("none"))
    return F.concat_ws(":", *[slug(F.col(f"{run}.{f}")) for f in fields])


def merged(df: DataFrame, keys: Sequence[str], value: str, complete: str, run: str, seq: str, carry: Sequence[str], lower: bool = False) -> DataFrame:
    """keys, n, ambiguous, value, complete, run_key and `carry` of the foremost disclosure of each key.

    Of rows of one identity the last (largest `seq`) counts. Order: complete before incomplete before unknown, then by
    run_key, then the better value (the lower one if `lower`), then by what is carried. A key with several identities
    is ambiguous. Rows are reduced to identities before they meet their key.
    """
    rows = df.withColumns({"__identity": identity(F.col(value), F.col(complete), F.col(run)), "run_key": run_key(df, run)})
    kept = F.struct(value, complete, "run_key", *carry)
    one = rows.groupBy(*keys, "__identity").agg(F.max_by(kept, seq).alias("kept")).select(*keys, "kept.*")
    rank = F.when(F.col(complete), 0).when(~F.col(complete), 1).otherwise(2)
    w = Window.partitionBy(*keys)
    order = [rank, F.col("run_key"), F.col(value).asc() if lower else F.col(value).desc(), *[F.col(c) for c in carry]]
    out = one.withColumns({"n": F.count(F.lit(1)).over(w), "__place": F.row_number().over(w.orderBy(*order))}).where("__place = 1")
    return out.select(*keys, "n", (F.col("n") > 1).alias("ambiguous"), value, complete, "run_key", *carry)
