"""The driver's tables as market data: daily bars, margin balances, positions, feeds.

Amounts are summed as whole cents, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, date, open, high, low, close, volume, cents: one bar for each supplier and shipping day."""
    lines = read(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    bars = lines.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(unit, order).alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.sum(cents("l_extendedprice")).alias("cents"),
    )
    return bars.withColumn("close", F.col("cents") / 100.0 / F.col("volume"))


#: The same bars in SQL.
BARS = """bars AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date,
         arg_min(l_extendedprice / l_quantity, l_orderkey * 100 + l_linenumber) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
         sum(l_quantity) AS volume, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / sum(l_quantity) AS close
  FROM lineitem GROUP BY 1, 2)"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close, cents: all codes of a day as one index."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"))
    bars = lines.agg(F.sum(cents("l_extendedprice")).alias("cents"), F.sum("l_quantity").alias("volume"))  # without its codes' bars: a row for each day moves
    return bars.select("date", "cents", (F.col("cents") / 100.0 / F.col("volume")).alias("close"))


BENCHMARK = """bench AS (
  SELECT date, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE / sum(volume) AS close FROM bars GROUP BY 1)"""


def margin_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, code, industry, cents: order totals by day, customer and market segment."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), cents("o_totalprice").alias("cents"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("industry"))
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.groupBy("date", F.col("o_custkey").alias("code"), "industry").agg(F.sum("cents").alias("cents"))


MARGIN = """margin AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS code, c_mktsegment AS industry,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""
