"""Named rules over rows and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, Column]


def failures(df: DataFrame, rules: Rules, into: str = "failed") -> DataFrame:
    """Adds the names of the rules that a row breaks, in the order of the rules; unknown counts as broken."""
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn(into, F.array_join(F.array_compact(F.array(*names)), ","))


def first_failure(df: DataFrame, rules: Rules, into: str = "fault") -> DataFrame:
    """Adds the first rule that a row breaks, null if none."""
    return df.withColumn(into, F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()], F.lit(None)))


def failure_counts(df: DataFrame, rules: Rules, keys: list[str]) -> DataFrame:
    """Rows of each group, and how many break each rule, in one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def snapshot_gate(rows: Column, valid: Column, universe: Column, beside: Column, expected: Column | None = None, least_coverage: float = 0.9, least_ratio: float = 0.9) -> Column:
    """struct<coverage, ratio, failures>: whether a snapshot is whole (V2).

    `beside` holds the valid counts of the snapshots beside it; nulls and zeros don't count, and of two the larger is
    the measure. Without any the snapshot fails; so it does if rows aren't as many as `expected`.
    """
    known = F.sort_array(F.filter(beside, lambda n: n > 0))
    middle = F.get(known, F.floor(F.size(known) / 2).cast("int"))
    coverage, ratio = F.coalesce(F.try_divide(rows.cast("double"), universe), F.lit(0.0)), F.try_divide(valid.cast("double"), middle)
    wrong = F.when(rows != expected, "rows") if expected is not None else F.lit(None).cast("string")
    failures = F.array_compact(F.array(wrong, F.when(coverage < least_coverage, "coverage"), F.when(ratio.isNull(), "no neighbours").when(ratio < least_ratio, "neighbours")))
    return F.struct(F.round(coverage, 6).alias("coverage"), F.round(ratio, 6).alias("ratio"), failures.alias("failures"))


#: What a code of the main boards, with its exchange, looks like.
STRICT_CODE = r"^(?:(?:60|68)\d{4}\.SH|(?:00|30)\d{4}\.SZ|(?:43|83|87|88|92)\d{4}\.BJ)$"


def delivery_gate(rows: DataFrame, asked: str, date: str, code: str, expected: DataFrame | None = None, least: int = 5_000) -> DataFrame:
    """asked, n, n_codes, failure: the first rule that each delivery of a day breaks, null if none (V1).

    Rules in order: date (a row of another day), code (not a strict code), unique (a code twice), rows (not as many as
    `expected` (asked, n_expected) says, where it does), coverage (fewer than `least` where it doesn't).
    """
    found = rows.groupBy(asked).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(code).alias("n_codes"),
        F.count_if(~F.col(date).eqNullSafe(F.col(asked))).alias("wrong_day"),
        F.count_if(~F.coalesce(F.col(code).rlike(STRICT_CODE), F.lit(False))).alias("wrong_code"),
    )
    found = found.join(expected, asked, "left") if expected is not None else found.withColumn("n_expected", F.lit(None).cast("long"))
    counted = F.when(F.col("n_expected") > 0, F.when(F.col("n") != F.col("n_expected"), "rows")).otherwise(F.when(F.col("n") < least, "coverage"))
    failure = F.when(F.col("wrong_day") > 0, "date").when(F.col("wrong_code") > 0, "code").when(F.col("n_codes") != F.col("n"), "unique").otherwise(counted)
    return found.select(asked, "n", "n_codes", failure.alias("failure"))
