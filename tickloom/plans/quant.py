"""Indicator, signal and back-test queries on daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import dates
from tickloom.operators import backtest, windows
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: hist stands for any oscillator: the close over its 10-bar mean, which SQL can say without recursion.
_HIST = f"""{t.BARS}, s AS (
  SELECT code, date, close, volume, count(*) OVER w5 AS n5, avg(close) OVER w5 AS a5, count(*) OVER w10 AS n10, avg(close) OVER w10 AS a10, count(*) OVER w20 AS n20, avg(close) OVER w20 AS a20 FROM bars
  WINDOW w5 AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING), w10 AS (PARTITION BY code ORDER BY date ROWS 9 PRECEDING), w20 AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
h AS (SELECT code, date, close, volume, CASE WHEN n5 = 5 THEN a5 END AS ma5, CASE WHEN n10 = 10 THEN a10 END AS ma10, CASE WHEN n20 = 20 THEN a20 END AS ma20,
  CASE WHEN n10 = 10 THEN round(close - a10, 6) END AS hist FROM s)"""


def _series(spark, sf_dir):
    w = windows.by(["code"])
    bars = t.daily_bars(spark, sf_dir)
    bars = bars.select("code", "date", "close", "volume", *[windows.sma("close", n, w).alias(f"ma{n}") for n in (5, 10, 20)])
    return bars.withColumn("hist", F.round(F.col("close") - F.col("ma10"), 6))


@query(f"""WITH {_HIST} SELECT code, date, round(ma5, 6) AS ma5, round(ma10, 6) AS ma10, round(ma20, 6) AS ma20 FROM h""")
def moving_averages(spark, sf_dir):
    """Simple means over 5, 10 and 20 bars, null until full."""
    return _series(spark, sf_dir).select("code", "date", *[F.round(f"ma{n}", 6).alias(f"ma{n}") for n in (5, 10, 20)])


@query(f"""WITH RECURSIVE {t.BARS}, o AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM bars),
e AS (SELECT code, rn, date, close AS e12, close AS e26, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS dea FROM o WHERE rn = 1
  UNION ALL SELECT o.code, o.rn, o.date, o.close * (2/13.0::DOUBLE) + e.e12 * (11/13.0::DOUBLE), o.close * (2/27.0::DOUBLE) + e.e26 * (25/27.0::DOUBLE),
    (o.close * (2/13.0::DOUBLE) + e.e12 * (11/13.0::DOUBLE)) - (o.close * (2/27.0::DOUBLE) + e.e26 * (25/27.0::DOUBLE)),
    ((o.close * (2/13.0::DOUBLE) + e.e12 * (11/13.0::DOUBLE)) - (o.close * (2/27.0::DOUBLE) + e.e26 * (25/27.0::DOUBLE))) * 0.2::DOUBLE + e.dea * 0.8::DOUBLE
  FROM e JOIN o ON o.code = e.code AND o.rn = e.rn + 1)
SELECT code, date, round(dif, 6) AS dif, round(dea, 6) AS dea, round(dif - dea, 6) AS hist FROM e""")
def macd_series(spark, sf_dir):
    """The recursive averages, their difference and its average."""
    return windows.macd(t.daily_bars(spark, sf_dir)).select("code", "date", *[F.round(c, 6).alias(c) for c in ("dif", "dea", "hist")])


@query(f"""WITH {_HIST}, l AS (SELECT *, lag(hist, 1) OVER w AS h1, lag(hist, 2) OVER w AS h2, lag(hist, 3) OVER w AS h3, lag(hist, 4) OVER w AS h4, lag(hist, 5) OVER w AS h5 FROM h WINDOW w AS (PARTITION BY code ORDER BY date)),
x AS (SELECT *, coalesce(h1 > 0 AND hist < 0, false) OR coalesce(h2 > 0 AND h1 < 0, false) OR coalesce(h3 > 0 AND h2 < 0, false) OR coalesce(h4 > 0 AND h3 < 0, false) OR coalesce(h5 > 0 AND h4 < 0, false) AS crossed FROM l)
SELECT code, date,
  coalesce(h4 > 0 AND h3 > 0 AND h2 > 0 AND h1 > 0 AND hist > 0 AND h4 > h3 AND h1 > h2 AND hist > h1, false) AS red_expand,
  coalesce(h4 > 0 AND h3 > 0 AND h2 > 0 AND h1 > 0 AND hist > 0 AND h3 > h4 AND h2 > h1 AND h1 > hist, false) AS red_shrink,
  crossed,
  coalesce(h2 < 0 AND h1 < 0 AND hist < 0 AND h1 > h2 AND hist > h1, false) AND crossed AS green_decay,
  coalesce(h2 < 0 AND h1 < 0 AND hist < 0 AND h1 < h2 AND hist < h1, false) AND crossed AS green_expand,
  coalesce(h1 < h2 AND hist < h1, false) AS falling
FROM x""")
def bar_patterns(spark, sf_dir):
    """Turns of a positive oscillator, crossings, and trends of a negative one."""
    w, hist = windows.by(["code"]), F.col("hist")
    return _series(spark, sf_dir).select(
        "code",
        "date",
        _turn(hist, w, True).alias("red_expand"),
        _turn(hist, w, False).alias("red_shrink"),
        windows.crossed_down(hist, 5, w).alias("crossed"),
        windows.green_trend(hist, 3, 5, w, True).alias("green_decay"),
        windows.green_trend(hist, 3, 5, w, False).alias("green_expand"),
        windows.falling(hist, 3, w).alias("falling"),
    )


def _turn(hist, w, expand):
    """Five bars: the first two moving one way, the last three the other."""
    return windows.red_turn(hist, 2, 3, w, expand)


@query(f"""WITH {_HIST}, l AS (SELECT *, lag(hist) OVER (PARTITION BY code ORDER BY date) AS h1 FROM h)
SELECT code, date, hist < 0 OR ma5 < ma10 OR hist < h1 AS weak, coalesce(close < ma20 AND ma5 < ma10, false) AS reversed,
  coalesce(close > ma10, false) AND coalesce(ma5 > ma20, false) AS trend_and, coalesce(close > ma10, false) OR coalesce(ma5 > ma20, false) AS trend_or,
  volume > 1.2 * (avg(volume) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING)) AS loud FROM l""")
def trend_masks(spark, sf_dir):
    """Weakness, reversal, trend and volume filters."""
    w = windows.by(["code"])
    c = F.col
    return _series(spark, sf_dir).select(
        "code",
        "date",
        ((c("hist") < 0) | (c("ma5") < c("ma10")) | (c("hist") < F.lag("hist").over(w))).alias("weak"),
        F.coalesce((c("close") < c("ma20")) & (c("ma5") < c("ma10")), F.lit(False)).alias("reversed"),
        (windows.trend_mask("close_gt_ma", c("close"), c("ma10"), c("ma20")) & windows.trend_mask("fast_gt_slow", c("close"), c("ma5"), c("ma20"))).alias("trend_and"),
        (windows.trend_mask("close_gt_ma", c("close"), c("ma10"), c("ma20")) | windows.trend_mask("fast_gt_slow", c("close"), c("ma5"), c("ma20"))).alias("trend_or"),
        (c("volume") > 1.2 * F.avg("volume").over(w.rowsBetween(-4, 0))).alias("loud"),
    )


@query(f"""WITH {t.BARS} SELECT code, count(*) AS n, min(date) AS first, max(date) AS last, count(*) < 252 AS short,
  CASE WHEN bool_or(low <= 0 OR volume < 0) THEN 'invalid' WHEN count(*) < 252 THEN 'short' ELSE 'ok' END AS reason,
  count(*) >= 120 AND date_diff('day', min(date), max(date)) >= 365 AS usable FROM bars GROUP BY code""")
def universe_summary(spark, sf_dir):
    """Rows, range and the reason why a code is out of the universe."""
    out = t.daily_bars(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.bool_or((F.col("low") <= 0) | (F.col("volume") < 0)).alias("bad"))
    reason = F.when(F.col("bad"), "invalid").when(F.col("n") < 252, "short").otherwise("ok")
    return out.select("code", "n", "first", "last", (F.col("n") < 252).alias("short"), reason.alias("reason"), ((F.col("n") >= 120) & (F.datediff("last", "first") >= 365)).alias("usable"))


@query(f"""WITH {t.BARS}, x AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars),
s AS (SELECT code, count(*) AS n, max(CASE WHEN rn = 1 THEN close END) AS current, avg(close) AS mean, max(close) AS high, min(close) AS low FROM x WHERE rn <= 60 GROUP BY 1 HAVING count(*) >= 5)
SELECT code, n, current, round(mean, 6) AS mean, high, low, CASE WHEN high = low THEN 0.5 ELSE (current - low) / (high - low) END AS position FROM s""")
def price_position(spark, sf_dir):
    """Where the last close stands in the range of the last 60."""
    last = Window.partitionBy("code").orderBy(F.col("date").desc())
    rows = t.daily_bars(spark, sf_dir).withColumn("rn", F.row_number().over(last)).where("rn <= 60")
    out = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("current"), F.avg("close").alias("m"), F.max("close").alias("high"), F.min("close").alias("low")).where("n >= 5")
    return out.select("code", "n", "current", F.round("m", 6).alias("mean"), "high", "low", F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("current") - F.col("low")) / (F.col("high") - F.col("low"))).alias("position"))


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, r AS (SELECT date, close, max(close) OVER (ORDER BY date) AS peak, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM bench)
SELECT count(*) AS n, round(avg(ret) * 252, 6) AS mean_year, round(stddev_samp(ret) * sqrt(252), 6) AS vol_year, round(max(1 - close / peak), 6) AS max_drawdown,
  round(arg_max(close, date) / arg_min(close, date) - 1, 6) AS total, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_share FROM r""")
def benchmark_metrics(spark, sf_dir):
    """Yearly return and volatility, largest draw-down, total return of the index."""
    w = Window.orderBy("date")  # one row for each day
    rows = t.benchmark(spark, sf_dir).select("date", "close", windows.drawdown(F.col("close"), w).alias("dd"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("ret") * 252, 6).alias("mean_year"),
        F.round(F.stddev_samp("ret") * F.sqrt(F.lit(252)), 6).alias("vol_year"),
        F.round(F.max("dd"), 6).alias("max_drawdown"),
        F.round(F.max_by("close", "date") / F.min_by("close", "date") - 1, 6).alias("total"),
        F.round(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), 6).alias("up_share"),
    )


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, n AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM bench), s AS (SELECT code, date, close, lead(date) OVER (PARTITION BY code ORDER BY date) AS own_next, lead(open) OVER (PARTITION BY code ORDER BY date) AS next_open FROM bars)
SELECT s.code, s.date, n.next, s.next_open FROM s JOIN n ON s.date = n.date AND s.own_next = n.next""")
def next_session_orders(spark, sf_dir):
    """A signal can be traded if the code has a bar on the index's next session."""
    n = t.benchmark(spark, sf_dir).select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))
    w = windows.by(["code"])
    s = t.daily_bars(spark, sf_dir).select("code", "date", F.lead("date").over(w).alias("own_next"), F.lead("open").over(w).alias("next_open"))
    return s.join(n, "date").where("own_next = next").select("code", "date", "next", "next_open")


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, opened AS (SELECT code, date FROM (SELECT code, date, volume, avg(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base FROM bars) WHERE volume > 2 * base),
weeks AS (SELECT DISTINCT date_trunc('week', date)::DATE AS week FROM bench), n AS (SELECT date_trunc('week', date)::DATE AS week, count(*) AS n FROM opened GROUP BY 1),
z AS (SELECT week, coalesce(n, 0) AS n FROM weeks LEFT JOIN n USING (week)), a AS (SELECT week, n, avg(n) OVER (ORDER BY week ROWS 12 PRECEDING) AS avg13, row_number() OVER (ORDER BY week) AS rn FROM z)
SELECT week, n, round(avg13, 6) AS avg13 FROM a WHERE rn >= 13""")
def weekly_openings(spark, sf_dir):
    """Openings a week, zero where none, and their mean over 13 weeks."""
    w = windows.by(["code"])
    bars = t.daily_bars(spark, sf_dir)
    opened = bars.withColumn("base", F.avg("volume").over(w.rowsBetween(-5, -1))).where("volume > 2 * base")
    week = F.trunc("date", "week").alias("week")
    weeks = bars.select(week).distinct().join(opened.groupBy(week).agg(F.count(F.lit(1)).alias("n")), "week", "left").select("week", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.orderBy("week")  # one row for each week
    return weeks.select("week", "n", F.round(F.avg("n").over(order.rowsBetween(-12, 0)), 6).alias("avg13"), F.row_number().over(order).alias("rn")).where("rn >= 13").drop("rn")


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, m AS (SELECT date, close, avg(close) OVER (ORDER BY date ROWS 59 PRECEDING) AS ma, count(*) OVER (ORDER BY date ROWS 59 PRECEDING) AS n FROM bench)
SELECT date, coalesce(n = 60 AND close > ma, false) AS allowed FROM m""")
def market_filter(spark, sf_dir):
    """The index over its 60-day mean; missing is no."""
    w = Window.orderBy("date")
    return t.benchmark(spark, sf_dir).select("date", F.coalesce(F.col("close") > windows.sma("close", 60, w), F.lit(False)).alias("allowed"))


@query("""SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, strftime(CAST(l_shipdate AS DATE), '%G-%V') AS iso_week,
  year(l_shipdate) || '-' || lpad(CAST(CAST(ceil(dayofyear(l_shipdate) / 7.0) AS INTEGER) AS VARCHAR), 2, '0') AS simple_week FROM lineitem""")
def week_keys(spark, sf_dir):
    """the two week keys."""
    days = t.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.select("date", dates.iso_week(F.col("date")).alias("iso_week"), dates.simple_week(F.col("date")).alias("simple_week"))


_MACD = """macd AS (SELECT code, date, rn, dif, dea, dif - dea AS hist FROM e)"""
_E = """o AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM bars),
e AS (SELECT code, rn, date, close AS e12, close AS e26, 0.0::DOUBLE AS dif, 0.0::DOUBLE AS dea FROM o WHERE rn = 1
  UNION ALL SELECT o.code, o.rn, o.date, o.close * (2/13.0::DOUBLE) + e.e12 * (11/13.0::DOUBLE), o.close * (2/27.0::DOUBLE) + e.e26 * (25/27.0::DOUBLE),
    (o.close * (2/13.0::DOUBLE) + e.e12 * (11/13.0::DOUBLE)) - (o.close * (2/27.0::DOUBLE) + e.e26 * (25/27.0::DOUBLE)),
    ((o.close * (2/13.0::DOUBLE) + e.e12 * (11/13.0::DOUBLE)) - (o.close * (2/27.0::DOUBLE) + e.e26 * (25/27.0::DOUBLE))) * 0.2::DOUBLE + e.dea * 0.8::DOUBLE
  FROM e JOIN o ON o.code = e.code AND o.rn = e.rn + 1)"""


def _turn_sql(signs):
    """Six positive bars, three falling then three rising (or the other way)."""
    a, b = signs
    h = [f"h{i}" if i else "hist" for i in range(5, -1, -1)]
    return " AND ".join([f"{x} > 0" for x in h] + [f"{x} {a} {y}" for x, y in zip(h[:2], h[1:3])] + [f"{x} {b} {y}" for x, y in zip(h[3:5], h[4:])])


_CROSSED = " OR ".join(f"coalesce(h{i + 1} > 0 AND {f'h{i}' if i else 'hist'} < 0, false)" for i in range(5))


@query(f"""WITH RECURSIVE {t.BARS}, {_E}, {_MACD},
l AS (SELECT b.code, b.date, b.close, b.volume, m.rn, dif, dea, hist, lag(dif) OVER w AS d1, lag(dea) OVER w AS e1, {', '.join(f'lag(hist, {i}) OVER w AS h{i}' for i in range(1, 6))},
  CASE WHEN m.rn >= 20 THEN avg(b.close) OVER (w ROWS 19 PRECEDING) END AS ma20, CASE WHEN m.rn >= 5 THEN avg(b.close) OVER (w ROWS 4 PRECEDING) END AS ma5, CASE WHEN m.rn >= 10 THEN avg(b.close) OVER (w ROWS 9 PRECEDING) END AS ma10, CASE WHEN m.rn >= 5 THEN avg(b.volume) OVER (w ROWS 4 PRECEDING) END AS v5
  FROM bars b JOIN macd m ON b.code = m.code AND b.date = m.date WINDOW w AS (PARTITION BY b.code ORDER BY b.date)),
k AS (SELECT *, coalesce({_turn_sql('><')}, false) AS red, coalesce(h2 < 0 AND h1 < 0 AND hist < 0 AND h1 > h2 AND hist > h1, false) AND ({_CROSSED}) AS green,
  coalesce({_turn_sql('<>')}, false) OR (coalesce(h2 < 0 AND h1 < 0 AND hist < 0 AND h1 < h2 AND hist < h1, false) AND ({_CROSSED})) AS sell,
  coalesce(close > ma20, false) OR coalesce(ma5 > ma10, false) AS trend, coalesce(dif > d1 OR dea > e1 OR hist > h1, false) AS rising, coalesce(volume > v5, false) AS loud FROM l)
SELECT code, date, (red OR green) AND trend AND rising AND loud AND rn > 252 AS buy, sell, round(greatest(0, least(100, 50 + CASE WHEN red THEN 18 ELSE 0 END + CASE WHEN green THEN 14 ELSE 0 END + greatest(-10, least(10, hist / close * 1000)) + CASE WHEN trend THEN 8 ELSE 0 END + CASE WHEN rising THEN 6 ELSE 0 END + CASE WHEN loud THEN 6 ELSE 0 END)), 5) AS score FROM k""")
def signal_rows(spark, sf_dir):
    """Buy, sell and score of every bar by the recursive averages, turns, trend, rise of any line, and volume; ready after 252 bars."""
    return backtest.signals(t.daily_bars(spark, sf_dir)).select("code", "date", "buy", "sell", F.round("score", 5).alias("score"))


_RULES = backtest.Rules(max_positions=10, warm_up=60)


@query()
def signal_backtest(spark, sf_dir):
    """The equity curve of one run. Trades are made code by code, and only the day by day part is one group:
    the best ranked signals of each day, at most twice the slots."""
    return backtest.equity_curve(t.daily_bars(spark, sf_dir), t.benchmark(spark, sf_dir), _RULES)


@query()
def signal_grid(spark, sf_dir):
    """The same over a grid of rules, with metrics and gates."""
    from dataclasses import replace

    rules = [replace(_RULES, max_positions=n, stop_loss=s) for n in (5, 10) for s in (0.05, 0.1)]
    return backtest.grid(t.daily_bars(spark, sf_dir), t.benchmark(spark, sf_dir), rules)


@query()
def run_metrics(spark, sf_dir):
    """All metrics of runs under each market filter, beside the index's."""
    from dataclasses import replace

    rules = [replace(_RULES, market=m) for m in ("none", "ma60", "ma120", "ma200", "slope20")]
    return backtest.grid(t.daily_bars(spark, sf_dir), t.benchmark(spark, sf_dir), rules)


@query()
def staged_search(spark, sf_dir):
    """M3: stage by stage, the first passing candidate is kept for the next."""
    stages = [("mode", [{"mode": "green_only"}, {"mode": "red_only"}]), ("loss", [{"stop_loss": x} for x in (0.08, 0.15)]), ("time", [{"max_days": n} for n in (20, 60)])]
    return backtest.staged_search(t.daily_bars(spark, sf_dir), t.benchmark(spark, sf_dir), _RULES, stages)


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, m AS (SELECT date, close, {', '.join(f"CASE WHEN count(*) OVER (ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (ORDER BY date ROWS {n - 1} PRECEDING) END AS m{n}" for n in (20, 60, 120, 200))} FROM bench)
SELECT date, coalesce(close > m60, false) AS ma60, coalesce(close > m120, false) AS ma120, coalesce(close > m200, false) AS ma200, coalesce(m20 > lag(m20) OVER (ORDER BY date), false) AS slope20 FROM m""")
def market_filters(spark, sf_dir):
    """The index over its means, and its short mean rising."""
    bench = t.benchmark(spark, sf_dir)
    out = bench.select("date")
    for kind in ("ma60", "ma120", "ma200", "slope20"):
        out = out.join(backtest.market_allows(bench, kind).withColumnRenamed("allowed", kind), "date")
    return out
