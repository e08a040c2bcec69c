"""Queries written in SQL that call what a session registered."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import extensions
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: A rule table that a user registers under a name of their own.
ENDS = [(r"^R", "returned"), (r"^AF$|^NF$", "final")]


@query("""WITH l AS (SELECT year(l_shipdate) AS year, CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'F' THEN 'final' ELSE 'open' END AS ends, l_quantity AS volume, l_extendedprice AS amount, l_extendedprice * (1 - l_discount) AS paid FROM lineitem),
c AS (SELECT year, ends, volume, count(*) AS n, max(round(amount, 2)) AS most, max(round((paid - amount) / amount * 100, 6)) AS change FROM l GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY year, ends ORDER BY volume) AS reached, sum(n) OVER (PARTITION BY year, ends) AS whole FROM c)
SELECT year, ends, CAST(sum(n) AS BIGINT) AS n, min(CASE WHEN reached * 2 >= whole THEN volume END) AS middle, max(most) AS most, max(change) AS change FROM s GROUP BY 1, 2""")
def sql_extensions(spark, sf_dir):
    """M9: SQL text over a table function (bars out of an order's text), scalar functions, a rule table, and an aggregate
    over counts by value, so that a group of the aggregate holds one row for each distinct value."""
    extensions.register(spark)
    extensions.register_rules(spark, "line_ends", ENDS, "open")
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    shown = F.concat(F.lit(" "), F.format_number(F.col("l_extendedprice"), 2), F.lit(" "))  # with commas, as a page shows it
    line = F.concat_ws(",", F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_extendedprice"), paid, F.lit(0), F.lit(0), F.col("l_quantity"))
    parts = F.struct(F.col("l_linenumber"), line.alias("line"), F.concat("l_returnflag", "l_linestatus").alias("flags"), shown.alias("shown"))
    lines = t.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(parts)).alias("parts"))  # an order has a few lines
    texts = lines.select("parts", F.array_join(F.col("parts")["line"], "\n").alias("body"))
    return spark.sql(
        """
        WITH bars AS (SELECT b.*, parts[b.at].flags AS flags, parts[b.at].shown AS shown FROM {texts}, LATERAL bars_of(body) AS b),
        counted AS (
          SELECT year(date) AS year, line_ends(flags) AS ends, volume, count(*) AS n, max(lenient_number(held_text(shown))) AS most, max(round(percent_change(close, open), 6)) AS change
          FROM bars GROUP BY year(date), line_ends(flags), volume),
        folded AS (SELECT year, ends, sum(n) AS n, max(most) AS most, max(change) AS change FROM counted GROUP BY year, ends),
        middles AS (SELECT year, ends, weighted_median(volume, n) AS middle FROM counted GROUP BY year, ends)
        SELECT year, ends, n, middle, most, change FROM folded JOIN middles USING (year, ends)
        """,
        texts=texts,
    )
