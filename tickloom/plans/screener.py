"""Screener queries on recursive averages: turning points, confirmation, levels, order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import windows
from tickloom.plans.quant import _E, _MACD
from tickloom.plans.register import query
from tickloom.sources import tables as t


def _lines(spark, sf_dir):
    return windows.macd(t.daily_bars(spark, sf_dir)).select("code", "date", "close", "dif", "dea", "hist")


@query(f"""WITH RECURSIVE {t.BARS}, {_E}, {_MACD}, l AS (SELECT code, date, rn, dif, {', '.join(f'lag(dif, {i}) OVER w AS d{i}' for i in range(1, 5))} FROM macd WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, coalesce(d1 < d2 AND dif > d1 AND abs(dif) <= 1, false) AS basic, coalesce(d3 < d4 AND d2 < d3 AND d1 > d2 AND dif > d1 AND abs(dif) <= 1, false) AS advanced,
  coalesce(d1 < d2 AND dif - d1 >= 0.5 * (d2 - d1) AND abs(dif) <= 1, false) AS final FROM l""")
def line_turns(spark, sf_dir):
    """Turns of the difference line near zero: a fall then a rise over three and five bars, and one that makes good half the fall."""
    w = windows.by(["code"])
    v = [F.col("dif"), *[F.lag("dif", i).over(w) for i in range(1, 5)]]
    near = F.abs(v[0]) <= 1
    no = F.lit(False)
    return _lines(spark, sf_dir).select(
        "code",
        "date",
        F.coalesce((v[1] < v[2]) & (v[0] > v[1]) & near, no).alias("basic"),
        F.coalesce((v[3] < v[4]) & (v[2] < v[3]) & (v[1] > v[2]) & (v[0] > v[1]) & near, no).alias("advanced"),
        F.coalesce((v[1] < v[2]) & (v[0] - v[1] >= 0.5 * (v[2] - v[1])) & near, no).alias("final"),
    )


@query(f"""WITH RECURSIVE {t.BARS}, {_E}, {_MACD}, l AS (SELECT code, date, dif, hist, lag(hist) OVER w AS h1, {', '.join(f'lag(dif, {i}) OVER w AS d{i}' for i in range(1, 4))} FROM macd WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, CASE WHEN d3 IS NULL THEN false ELSE (least(d2, d1, dif) < d3 AND dif > least(d3, d2, d1, dif)) OR coalesce(hist > h1, false) END AS confirms FROM l""")
def short_confirmation(spark, sf_dir):
    """Four bars of the short series confirm if the line is off a low that isn't the oldest of them, or the histogram rises."""
    w = windows.by(["code"])
    d1, d2, d3 = (F.lag("dif", i).over(w) for i in (1, 2, 3))
    dif = F.col("dif")
    low = F.least(d3, d2, d1, dif)
    rebound = (F.least(d2, d1, dif) < d3) & (dif > low)
    return _lines(spark, sf_dir).select("code", "date", F.when(d3.isNull(), False).otherwise(rebound | F.coalesce(F.col("hist") > F.lag("hist").over(w), F.lit(False))).alias("confirms"))


_LEVEL = "CASE WHEN score >= 70 THEN 'strong' WHEN score >= 50 THEN 'candidate' WHEN score >= 30 THEN 'watch' ELSE 'none' END"


@query(f"""WITH RECURSIVE {t.BARS}, {_E}, {_MACD}, l AS (SELECT code, date, dif, dea, hist, lag(dif) OVER w AS d1, lag(dea) OVER w AS e1, lag(hist) OVER w AS h1, lag(hist, 2) OVER w AS h2, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM macd WINDOW w AS (PARTITION BY code ORDER BY date)),
s AS (SELECT code, date, hist, CASE WHEN dif > dea THEN 20 ELSE 0 END + CASE WHEN dif > d1 THEN 15 ELSE 0 END + CASE WHEN dea > e1 THEN 10 ELSE 0 END + CASE WHEN hist > 0 AND hist > h1 AND h1 >= h2 THEN 25 WHEN hist > h1 THEN 15 ELSE 0 END + CASE WHEN dif > 0 THEN 10 ELSE 0 END AS score,
  concat_ws(',', CASE WHEN dif > dea THEN 'above' END, CASE WHEN dif > d1 THEN 'rising' END, CASE WHEN hist > 0 AND hist > h1 AND h1 >= h2 THEN 'red' END) AS tags FROM l WHERE back = 1)
SELECT code, date, score, tags, {_LEVEL} AS level, row_number() OVER (ORDER BY {_LEVEL} IN ('strong', 'candidate') DESC, score DESC, hist DESC, code) AS place FROM s""")
def screener(spark, sf_dir):
    """The last bar of each code scored on its lines, with tags and level; candidates first, then score, then histogram. One row for each code."""
    w, c = windows.by(["code"]), F.col
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.col("date").desc()))
    rows = _lines(spark, sf_dir).withColumns({"d1": F.lag("dif").over(w), "e1": F.lag("dea").over(w), "h1": F.lag("hist").over(w), "h2": F.lag("hist", 2).over(w), "back": back}).where("back = 1")
    red = (c("hist") > 0) & (c("hist") > c("h1")) & (c("h1") >= c("h2"))
    points = lambda x, n: F.when(x, n).otherwise(0)
    score = points(c("dif") > c("dea"), 20) + points(c("dif") > c("d1"), 15) + points(c("dea") > c("e1"), 10) + F.when(red, 25).when(c("hist") > c("h1"), 15).otherwise(0) + points(c("dif") > 0, 10)
    tags = F.array_join(F.array_compact(F.array(F.when(c("dif") > c("dea"), "above"), F.when(c("dif") > c("d1"), "rising"), F.when(red, "red"))), ",")
    rows = rows.select("code", "date", "hist", score.alias("score"), tags.alias("tags")).withColumn("level", F.expr(_LEVEL))
    place = F.row_number().over(Window.orderBy(c("level").isin("strong", "candidate").desc(), c("score").desc(), c("hist").desc(), "code"))
    return rows.select("code", "date", "score", "tags", "level", place.cast("long").alias("place"))
