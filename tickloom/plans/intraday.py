"""Bars at two scales from ticks: 15 minutes within sessions beside days, confirmation, and a day's candles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars, merging, windows
from tickloom.plans.quant import _E, _MACD
from tickloom.plans.register import query
from tickloom.sources import tables as t


def ticks(spark, sf_dir):
    """id, code, at, price: a reaction's value as the price of its user, moved into the day's hours."""
    at = F.to_timestamp(F.to_date("ts")) + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(0), F.floor((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 4).cast("double"))
    return t.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("code"), at.alias("at"), F.col("value").alias("price"))


_TICKS = """tk AS (SELECT event_id AS id, user_id AS code, value AS price, date_trunc('day', ts) + INTERVAL 9 HOUR + to_seconds((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 4) AS moment FROM events),
ss AS (SELECT *, hour(moment) * 60 + minute(moment) AS m FROM tk),
se AS (SELECT *, CASE WHEN m >= 570 AND m < 690 THEN 570 WHEN m >= 780 AND m < 900 THEN 780 END AS b FROM ss),
days AS (SELECT code, moment::DATE AS day, arg_max(price, (moment, id)) AS close FROM tk GROUP BY 1, 2)"""


def _bars_sql(minutes, name):
    return f"""{name} AS (SELECT code, moment::DATE AS day, b, (m - b) // {minutes} AS k, date_trunc('day', min(moment)) + to_minutes(CAST(b + (m - b) // {minutes} * {minutes} AS INTEGER)) AS slot,
  arg_min(price, (moment, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (moment, id)) AS close, count(*) AS n FROM se WHERE b IS NOT NULL GROUP BY 1, 2, 3, 4)"""


_ENOUGH = f"""{_TICKS}, {_bars_sql(15, 'b15')}, ok AS (SELECT code FROM b15 GROUP BY 1 HAVING count(*) >= 10 INTERSECT SELECT code FROM days GROUP BY 1 HAVING count(*) >= 10)"""


def _short(spark, sf_dir):
    """15-minute bars and daily closes of the codes that have ten of both."""
    rows = ticks(spark, sf_dir)
    daily = rows.groupBy("code", F.to_date("at").alias("day")).agg(F.max_by("price", F.struct("at", "id")).alias("close"))
    short = bars.session_bars(rows, 15)
    return bars.with_enough(short, daily), bars.with_enough(daily, short)


@query(f"""WITH {_ENOUGH}, g AS (SELECT code, day, slot, open, high, low, close, n, k - coalesce(lag(k) OVER (PARTITION BY code, day, b ORDER BY k), -1) - 1 AS missing FROM b15 WHERE code IN (SELECT code FROM ok))
SELECT g.code, slot, open, high, low, g.close, n, missing, d.close AS day_before FROM g ASOF LEFT JOIN days d ON d.code = g.code AND g.day > d.day""")
def intraday_bars(spark, sf_dir):
    """15-minute bars within sessions, with the slots missing before each, beside the last close of the days before."""
    short, daily = _short(spark, sf_dir)
    out = merging.as_of(short, daily.select("code", F.col("day").alias("seen"), F.col("close").alias("day_before")), ["code"], "day", "seen", ["day_before"], strict=True)
    return out.select("code", "slot", "open", "high", "low", "close", "n", "missing", "day_before")


@query(f"""WITH RECURSIVE {_ENOUGH}, bars AS (SELECT code, slot AS date, close FROM b15 WHERE code IN (SELECT code FROM ok)), {_E}, {_MACD},
l AS (SELECT code, date, dif, hist, lag(hist) OVER w AS h1, {', '.join(f'lag(dif, {i}) OVER w AS d{i}' for i in range(1, 4))}, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM macd WINDOW w AS (PARTITION BY code ORDER BY date)),
dl AS (SELECT code, close, lag(close) OVER (PARTITION BY code ORDER BY day) AS before, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS back FROM days)
SELECT l.code, date AS slot, CASE WHEN d3 IS NULL THEN false ELSE (least(d2, d1, dif) < d3 AND dif > least(d3, d2, d1, dif)) OR coalesce(hist > h1, false) END AS confirms, dl.close > dl.before AS day_rose FROM l JOIN dl ON dl.code = l.code AND dl.back = 1 WHERE l.back = 1""")
def intraday_confirmation(spark, sf_dir):
    """Whether the last four 15-minute bars of a code confirm what its last day did."""
    short, daily = _short(spark, sf_dir)
    w = windows.by(["code"])
    lines = windows.macd(short.select("code", F.col("slot").alias("date"), "close"))
    d1, d2, d3 = (F.lag("dif", i).over(w) for i in (1, 2, 3))
    dif = F.col("dif")
    rebound = (F.least(d2, d1, dif) < d3) & (dif > F.least(d3, d2, d1, dif))
    confirms = F.when(d3.isNull(), False).otherwise(rebound | F.coalesce(F.col("hist") > F.lag("hist").over(w), F.lit(False)))
    last = merging.pick(lines.withColumn("confirms", confirms), ["code"], [F.col("date").desc()])
    days = Window.partitionBy("code").orderBy("day")
    rose = merging.pick(daily.withColumn("day_rose", F.col("close") > F.lag("close").over(days)), ["code"], [F.col("day").desc()])
    return last.join(rose.select("code", "day_rose"), "code").select("code", F.col("date").alias("slot"), "confirms", "day_rose")


@query(f"""WITH {_TICKS}, {_bars_sql(15, 'b15')}, {_bars_sql(5, 'b5')}, c AS (SELECT code, day, slot, 15 AS period, close, n FROM b15 UNION ALL SELECT code, day, slot, 5, close, n FROM b5),
l AS (SELECT * FROM c QUALIFY day = max(day) OVER (PARTITION BY code)),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY code, slot ORDER BY period <> CASE WHEN strftime(slot, '%H:%M') > '14:30' THEN 5 ELSE 15 END, period) = 1),
r AS (SELECT *, CASE WHEN lag(n) OVER w > 0 THEN n * 1.0::DOUBLE / lag(n) OVER w END AS ratio FROM o WINDOW w AS (PARTITION BY code ORDER BY slot)) SELECT code, slot, period, close, max(ratio) OVER (PARTITION BY code) AS max_ratio FROM r""")
def latest_day_candles(spark, sf_dir):
    """Of the last day one candle a time, of 5 minutes after 14:30 and of 15 before where there is one, and the largest growth of activity between candles."""
    rows = ticks(spark, sf_dir)
    each = [bars.session_bars(rows, m).select("code", "slot", F.lit(m).alias("period"), "close", "n") for m in (15, 5)]
    one = bars.one_of_each_time(each[0].unionByName(each[1]))
    before = F.lag("n").over(Window.partitionBy("code").orderBy("slot"))
    one = one.withColumn("ratio", F.try_divide(F.col("n").cast("double"), before))
    return one.select("code", "slot", "period", "close", F.max("ratio").over(Window.partitionBy("code")).alias("max_ratio"))
