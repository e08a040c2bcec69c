"""Funds, positions, returns and anomalies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import ranking
from tickloom.plans.register import query
from tickloom.sources import tables as t

_POS = """pos AS (SELECT o_custkey AS fund, l_suppkey AS code, l_quantity AS shares, l_extendedprice / l_quantity AS cost, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE p_retailprice END AS current,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE p_retailprice * (1 + (l_tax - 0.04) / 10) END AS prev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def positions(spark, sf_dir):
    """fund, code, shares, cost, current and previous price (either may lack)."""
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    orders = t.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = t.read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("p_retailprice")
    return rows.select(
        F.col("o_custkey").alias("fund"),
        F.col("l_suppkey").alias("code"),
        F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("cost"),
        F.when(F.col("l_linenumber") % 5 != 0, price).alias("current"),
        F.when(F.col("l_linenumber") % 4 != 0, price * (1 + (F.col("l_tax") - 0.04) / 10)).alias("prev"),
    )


@query(f"""WITH {_POS} SELECT fund, count(*) AS n, round(sum(shares * cost), 2) AS cost, round(sum(shares * coalesce(current, cost)), 2) AS value, round(sum(shares * coalesce(current, cost)) - sum(shares * cost), 2) AS profit,
 round(100 * (sum(shares * coalesce(current, cost)) / sum(shares * cost) - 1), 6) AS profit_pct FROM pos GROUP BY 1""")
def fund_totals(spark, sf_dir):
    """Cost, market value and profit of each fund; a missing price is the cost."""
    value = F.sum(F.col("shares") * F.coalesce("current", "cost"))
    cost = F.sum(F.col("shares") * F.col("cost"))
    return positions(spark, sf_dir).groupBy("fund").agg(F.count(F.lit(1)).alias("n"), F.round(cost, 2).alias("cost"), F.round(value, 2).alias("value"), F.round(value - cost, 2).alias("profit"), F.round(100 * (F.try_divide(value, cost) - 1), 6).alias("profit_pct"))


@query(f"""WITH {_POS}, s AS (SELECT fund, sum(shares * coalesce(current, cost)) AS now, sum(shares * coalesce(prev, current, cost)) AS before FROM pos GROUP BY 1)
SELECT fund, round(CASE WHEN before > 0 THEN 100 * (now - before) / before ELSE 0 END, 6) AS daily_pct FROM s""")
def fund_daily_return(spark, sf_dir):
    """Value-weighted return on the previous prices; 0 without a base."""
    now, before = F.sum(F.col("shares") * F.coalesce("current", "cost")), F.sum(F.col("shares") * F.coalesce("prev", "current", "cost"))
    out = positions(spark, sf_dir).groupBy("fund").agg(now.alias("now"), before.alias("before"))
    return out.select("fund", F.round(F.when(F.col("before") > 0, 100 * (F.col("now") - F.col("before")) / F.col("before")).otherwise(0.0), 6).alias("daily_pct"))


@query(f"""WITH {_POS}, m AS (SELECT fund, code, max(100 * (current - prev) / prev) AS pct FROM pos WHERE current IS NOT NULL AND prev > 0 GROUP BY 1, 2)
SELECT fund, count(*) AS n, count(*) FILTER (WHERE pct > 0) AS up, count(*) FILTER (WHERE pct < 0) AS down, count(*) FILTER (WHERE pct = 0) AS flat, round(avg(pct), 6) AS mean_pct FROM m GROUP BY 1""")
def fund_board(spark, sf_dir):
    """Gainers, losers and mean change; positions without a previous price aren't counted."""
    m = _moves(spark, sf_dir)
    return m.groupBy("fund").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pct") > 0).alias("up"), F.count_if(F.col("pct") < 0).alias("down"), F.count_if(F.col("pct") == 0).alias("flat"), F.round(F.avg("pct"), 6).alias("mean_pct"))


def _moves(spark, sf_dir):
    rows = positions(spark, sf_dir).where("current IS NOT NULL AND prev > 0")
    return rows.groupBy("fund", "code").agg(F.max(100 * (F.col("current") - F.col("prev")) / F.col("prev")).alias("pct"))


@query(f"""WITH {_POS}, m AS (SELECT fund, code, max(100 * (current - prev) / prev) AS pct FROM pos WHERE current IS NOT NULL AND prev > 0 GROUP BY 1, 2), f AS (SELECT fund, avg(pct) >= 0 AS up FROM m GROUP BY 1)
SELECT fund, code, round(pct, 6) AS pct, rn AS rank FROM (SELECT fund, code, pct, row_number() OVER (PARTITION BY fund ORDER BY CASE WHEN up THEN -pct ELSE pct END, code) AS rn FROM m JOIN f USING (fund)) WHERE rn <= 3""")
def top_movers(spark, sf_dir):
    """Three movers of each fund, in the direction the fund went."""
    m = _moves(spark, sf_dir)
    m = m.withColumn("up", F.avg("pct").over(Window.partitionBy("fund")) >= 0)
    top = ranking.top_n(m, ["fund"], [F.when(F.col("up"), -F.col("pct")).otherwise(F.col("pct")), F.col("code")], 3)
    return top.select("fund", "code", F.round("pct", 6).alias("pct"), "rank")


@query(f"""WITH {_POS}, v AS (SELECT fund, code, sum(shares * coalesce(current, cost)) AS value, sum(shares * coalesce(current, cost)) - sum(shares * cost) AS profit FROM pos GROUP BY 1, 2)
SELECT fund, code, round(100 * value / sum(value) OVER (PARTITION BY fund), 6) AS weight_pct, round(value, 2) AS value FROM v""")
def position_weights(spark, sf_dir):
    """Weight of each code in its fund, on refreshed totals."""
    v = positions(spark, sf_dir).groupBy("fund", "code").agg(F.sum(F.col("shares") * F.coalesce("current", "cost")).alias("v"))
    return v.select("fund", "code", F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy("fund")), 6).alias("weight_pct"), F.round("v", 2).alias("value"))


@query("""WITH r AS (SELECT o_custkey AS fund, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderkey AS seq FROM orders WHERE year(o_orderdate) = 1997 AND o_totalprice > 0)
SELECT fund, arg_min(value, date::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS first_value, arg_max(value, date::VARCHAR || lpad(seq::VARCHAR, 12, '0')) AS last_value,
 round(100 * (arg_max(value, date::VARCHAR || lpad(seq::VARCHAR, 12, '0')) / arg_min(value, date::VARCHAR || lpad(seq::VARCHAR, 12, '0')) - 1), 6) AS ytd_pct FROM r GROUP BY 1""")
def year_to_date(spark, sf_dir):
    """Return since the first valid record of the year."""
    rows = t.read(spark, sf_dir, "orders").where("year(o_orderdate) = 1997 AND o_totalprice > 0")
    order = F.struct(F.to_date("o_orderdate"), "o_orderkey")
    first, last = F.min_by("o_totalprice", order), F.max_by("o_totalprice", order)
    return rows.groupBy(F.col("o_custkey").alias("fund")).agg(first.alias("first_value"), last.alias("last_value"), F.round(100 * (last / first - 1), 6).alias("ytd_pct"))


@query(f"""WITH {t.MARGIN}, d AS (SELECT industry, date, CAST(sum(cents) AS DOUBLE) AS v, count(*) AS n FROM margin GROUP BY 1, 2), x AS (SELECT industry, date, v / lag(v) OVER (PARTITION BY industry ORDER BY date) AS g FROM d)
SELECT industry, date, round(sum(CASE WHEN g > 0 THEN ln(g) ELSE 0 END) OVER (PARTITION BY industry ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS log_nav FROM x""")
def nav_chain(spark, sf_dir):
    """Chained value of each group: every day's ratio to the day before, as a running sum of logs."""
    d = t.margin_balances(spark, sf_dir).groupBy("industry", "date").agg(F.sum("cents").cast("double").alias("v"))
    w = Window.partitionBy("industry").orderBy("date")
    d = d.withColumn("g", F.col("v") / F.lag("v").over(w))
    run = F.sum(F.when(F.col("g") > 0, F.ln("g")).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select("industry", "date", F.round(run, 6).alias("log_nav"))


@query(f"""WITH {_POS}, h AS (SELECT DISTINCT fund, code FROM pos), n AS (SELECT code, count(*) AS n FROM h GROUP BY 1)
SELECT h.fund, count(*) AS n_codes, max(n.n) AS most_shared, string_agg(h.code::VARCHAR, ',' ORDER BY h.code) AS codes FROM h JOIN n USING (code) GROUP BY 1""")
def shared_holdings(spark, sf_dir):
    """A fund's codes and how many funds hold the most shared one; counts instead of pairs of funds."""
    held = positions(spark, sf_dir).select("fund", "code").distinct()
    n = held.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    out = held.join(n, "code").groupBy("fund").agg(F.count(F.lit(1)).alias("n_codes"), F.max("n").alias("most_shared"), F.sort_array(F.collect_list("code")).alias("codes"))
    return out.withColumn("codes", F.array_join(F.transform("codes", lambda c: c.cast("string")), ","))


@query(f"""WITH {t.BARS}, r AS (SELECT code, date, 100.0::DOUBLE * (close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1) AS pct FROM bars), s AS (SELECT s_suppkey AS code, s_nationkey AS theme FROM supplier),
x AS (SELECT code, date, theme, pct, count(*) FILTER (WHERE abs(pct) >= 30) OVER (PARTITION BY date, theme) AS peers FROM r JOIN s USING (code) WHERE pct IS NOT NULL)
SELECT code, date, round(pct, 6) AS pct, CASE WHEN abs(pct) >= 60 THEN 'direct' WHEN peers - 1 >= 2 THEN 'theme' WHEN peers - 1 >= 1 THEN 'peer' ELSE 'unknown' END AS reason FROM x WHERE abs(pct) >= 30""")
def anomaly_reasons(spark, sf_dir):
    """Why a code moved: by itself, with its theme, with a peer, or unknown."""
    w = Window.partitionBy("code").orderBy("date")
    rows = t.daily_bars(spark, sf_dir).select("code", "date", (100.0 * (F.col("close") / F.lag("close").over(w) - 1)).alias("pct")).where("pct IS NOT NULL")
    theme = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("theme"))
    rows = rows.where("abs(pct) >= 30").join(theme, "code").withColumn("peers", F.count(F.lit(1)).over(Window.partitionBy("date", "theme")))
    reason = F.when(F.abs("pct") >= 60, "direct").when(F.col("peers") - 1 >= 2, "theme").when(F.col("peers") - 1 >= 1, "peer").otherwise("unknown")
    return rows.select("code", "date", F.round("pct", 6).alias("pct"), reason.alias("reason"))


@query(f"""WITH {t.BARS}, m AS (SELECT code, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS close FROM bars GROUP BY 1, 2), codes AS (SELECT code, min(month) AS a FROM m GROUP BY 1), e AS (SELECT max(month) AS b FROM m),
s AS (SELECT code, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS month FROM codes, e),
f AS (SELECT s.code, s.month, m.close IS NOT NULL AS fresh, last_value(m.close IGNORE NULLS) OVER w AS now, last_value(m.close IGNORE NULLS) OVER (PARTITION BY s.code ORDER BY s.month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s LEFT JOIN m ON m.code = s.code AND m.month = s.month WINDOW w AS (PARTITION BY s.code ORDER BY s.month ROWS UNBOUNDED PRECEDING)),
v AS (SELECT s_nationkey AS fund, month, count(*) AS n, count(*) FILTER (WHERE fresh) AS n_fresh, sum((code % 9 + 1) * now) AS now, sum((code % 9 + 1) * coalesce(before, now)) AS before FROM f JOIN supplier ON s_suppkey = code GROUP BY 1, 2),
g AS (SELECT *, n_fresh >= greatest(1, ceil(n * 0.8)) AS reliable FROM v)
SELECT fund, month, n, n_fresh, reliable, round(sum(CASE WHEN reliable THEN ln(now / before) ELSE 0 END) OVER (PARTITION BY fund ORDER BY month ROWS UNBOUNDED PRECEDING), 6) AS log_nav FROM g""")
def fund_nav(spark, sf_dir):
    """A fund's chained value, which moves only where four in five of its positions have a fresh price; others keep their last."""
    month = F.trunc("date", "month")
    seen = t.daily_bars(spark, sf_dir).groupBy("code", month.alias("month")).agg(F.max_by("close", "date").alias("close"))
    end = seen.agg(F.max("month")).first()[0]
    spine = seen.groupBy("code").agg(F.min("month").alias("a")).select("code", F.explode(F.expr(f"sequence(a, date'{end}', interval 1 month)")).alias("month"))
    w = Window.partitionBy("code").orderBy("month")
    upto = lambda last: F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, last))
    rows = spine.join(seen, ["code", "month"], "left").select("code", "month", F.col("close").isNotNull().alias("fresh"), upto(0).alias("now"), upto(-1).alias("before"))
    funds = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("fund"), (F.col("s_suppkey") % 9 + 1).alias("shares"))
    value = lambda c: F.sum(F.col("shares") * c)
    out = rows.join(funds, "code").groupBy("fund", "month").agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("n_fresh"), value(F.col("now")).alias("now"), value(F.coalesce("before", "now")).alias("before"))
    out = out.withColumn("reliable", F.col("n_fresh") >= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.8)))
    run = F.sum(F.when(F.col("reliable"), F.ln(F.col("now") / F.col("before"))).otherwise(0.0)).over(Window.partitionBy("fund").orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return out.select("fund", "month", "n", "n_fresh", "reliable", F.round(run, 6).alias("log_nav"))
