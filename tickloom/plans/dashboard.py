"""Series of observations: months, weeks, prices, quotes, capital, winners, credit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import dates
from tickloom.operators import costs, credit, merging, ranking
from tickloom.plans.register import query
from tickloom.sources import tables as t

_OBS = """obs AS (SELECT o_orderkey AS seq, o_custkey AS company, CAST(o_orderdate AS DATE) AS observed, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS kind FROM orders)"""


def observations(spark, sf_dir):
    orders = t.read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("observed"), t.cents("o_totalprice").alias("cents"), F.col("o_orderstatus").alias("kind"))


_MONTHS = f"""{_OBS}, latest AS (SELECT company, date_trunc('month', observed)::DATE AS month, cents, observed FROM obs QUALIFY row_number() OVER (PARTITION BY company, date_trunc('month', observed) ORDER BY observed DESC, seq DESC) = 1)"""


def _months(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("month", F.trunc("observed", "month"))
    return merging.pick(rows, ["company", "month"], [F.col("observed").desc(), F.col("seq").desc()]).select("company", "month", "cents", "observed")


@query(f"""WITH {_MONTHS}, l AS (SELECT *, lag(cents) OVER w AS before, lag(month) OVER w AS month_before FROM latest WINDOW w AS (PARTITION BY company ORDER BY month))
SELECT company, month, cents, cents - before AS change, (cents - before) * 1.0::DOUBLE / before AS change_share, coalesce(month_before = month - INTERVAL 1 MONTH, false) AS consecutive, DATE '1998-08-02' - max(observed) OVER (PARTITION BY company) > 18 AS stale FROM l""")
def monthly_latest(spark, sf_dir):
    """The last observation of each month against that of the month before it, and whether the newest is over 18 days old."""
    w = Window.partitionBy("company").orderBy("month")
    before = F.lag("cents").over(w)
    return _months(spark, sf_dir).select("company", "month", "cents", (F.col("cents") - before).alias("change"), ((F.col("cents") - before) * 1.0 / before).alias("change_share"), F.coalesce(F.lag("month").over(w) == F.add_months("month", -1), F.lit(False)).alias("consecutive"), (F.datediff(F.lit("1998-08-02").cast("date"), F.max("observed").over(Window.partitionBy("company"))) > 18).alias("stale"))


@query(f"""WITH {_MONTHS} SELECT month, CAST(sum(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN cents END) AS BIGINT) AS automobile, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN cents END) AS BIGINT) AS building, CAST(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN cents END) AS BIGINT) AS machinery
FROM latest JOIN customer ON company = c_custkey GROUP BY 1""")
def monthly_pivot(spark, sf_dir):
    """Months by segment of the companies' last observations, null where none."""
    segments = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), "c_mktsegment")
    out = _months(spark, sf_dir).join(segments, "company").groupBy("month").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).agg(F.sum("cents"))
    return out.select("month", *[F.col(c).alias(c.lower()) for c in ("AUTOMOBILE", "BUILDING", "MACHINERY")])


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(round(value * 1000) AS BIGINT) AS tokens FROM events), b AS (SELECT CAST(floor(date_diff('day', day, DATE '2024-01-30') / 7) AS BIGINT) AS bucket, CAST(sum(tokens) AS BIGINT) AS tokens FROM e WHERE day <= DATE '2024-01-30' GROUP BY 1)
SELECT bucket, tokens, tokens - lag(tokens) OVER (ORDER BY bucket DESC) AS change, CAST(trunc((tokens - lag(tokens) OVER (ORDER BY bucket DESC)) * 1000000.0::DOUBLE / lag(tokens) OVER (ORDER BY bucket DESC)) AS BIGINT) AS change_millionths FROM b WHERE bucket < 12""")
def weekly_tokens(spark, sf_dir):
    """Windows of seven days that end at a date, exact sums, change cut at a millionth."""
    end = F.lit("2024-01-30").cast("date")
    rows = t.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.round(F.col("value") * 1000).cast("decimal(38,0)").alias("tokens")).where(F.col("day") <= end)
    weeks = rows.groupBy(F.floor(F.datediff(end, "day") / 7).alias("bucket")).agg(F.sum("tokens").cast("long").alias("tokens")).where("bucket < 12")
    before = F.lag("tokens").over(Window.orderBy(F.col("bucket").desc()))
    share = (F.col("tokens") - before) * 1_000_000.0 / before
    return weeks.select("bucket", "tokens", (F.col("tokens") - before).alias("change"), F.when(share < 0, F.ceil(share)).otherwise(F.floor(share)).alias("change_millionths"))


_PRICES = """prices AS (SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS as_of, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / l_quantity AS input_price, l_tax AS output_price FROM lineitem),
p AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY sku, as_of ORDER BY seq DESC) = 1)"""


def prices(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), F.to_date("l_shipdate").alias("as_of"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("input_price"), F.col("l_tax").alias("output_price"))
    return merging.pick(lines, ["sku", "as_of"], [F.col("seq").desc()])


@query(f"""WITH {_PRICES}, u AS (SELECT sku, as_of, 'input' AS field, input_price AS price FROM p UNION ALL SELECT sku, as_of, 'output', output_price FROM p),
l AS (SELECT *, lag(price) OVER (PARTITION BY sku, field ORDER BY as_of) AS before FROM u) SELECT sku, as_of, field, before, price FROM l WHERE before IS NOT NULL AND before <> price""")
def price_changes(spark, sf_dir):
    """An event for each price field that moved, field by field."""
    long = prices(spark, sf_dir).select("sku", "as_of", F.expr("stack(2, 'input', input_price, 'output', output_price) AS (field, price)"))
    w = Window.partitionBy("sku", "field").orderBy("as_of")
    return long.withColumn("before", F.lag("price").over(w)).where("before IS NOT NULL AND before <> price").select("sku", "as_of", "field", "before", "price")


@query(f"""WITH {_PRICES}, l AS (SELECT sku, as_of, input_price, lag(input_price) OVER w AS before, row_number() OVER (PARTITION BY sku ORDER BY as_of DESC) = 1 AS latest FROM p WINDOW w AS (PARTITION BY sku ORDER BY as_of))
SELECT sku, as_of, input_price, before, input_price - before AS change, latest FROM l""")
def quote_changes(spark, sf_dir):
    """Each quote against the one before; one latest row a key."""
    w = Window.partitionBy("sku")
    before = F.lag("input_price").over(w.orderBy("as_of"))
    return prices(spark, sf_dir).select("sku", "as_of", "input_price", before.alias("before"), (F.col("input_price") - before).alias("change"), (F.row_number().over(w.orderBy(F.col("as_of").desc())) == 1).alias("latest"))


@query(f"""WITH {_PRICES}, runs AS (SELECT o_orderkey AS run, l_linenumber AS part, l_partkey AS sku, CAST(o_orderdate AS DATE) AS run_day FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT run, part, runs.sku, run_day, p.as_of, p.input_price FROM runs ASOF LEFT JOIN p ON runs.sku = p.sku AND runs.run_day >= p.as_of""")
def runs_as_of_prices(spark, sf_dir):
    """A run at the price last seen, not after it."""
    orders = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.to_date("o_orderdate").alias("run_day"))
    parts = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("part"), F.col("l_partkey").alias("sku"))
    runs = orders.join(parts, "run").select("run", "part", "sku", "run_day")
    return merging.as_of(runs, prices(spark, sf_dir), ["sku"], "run_day", "as_of", ["input_price"])


@query(f"""WITH {_PRICES}, l AS (SELECT sku, as_of, input_price FROM p)
SELECT a.sku, a.as_of, a.input_price, a.input_price - d.input_price AS change_7d, a.input_price - m.input_price AS change_month FROM l a
ASOF LEFT JOIN l d ON a.sku = d.sku AND a.as_of - INTERVAL 7 DAY >= d.as_of ASOF LEFT JOIN l m ON a.sku = m.sku AND a.as_of - INTERVAL 1 MONTH >= m.as_of""")
def changes_over_time(spark, sf_dir):
    """Change on the value last seen a week and a (clamped) month ago."""
    rows = prices(spark, sf_dir).select("sku", "as_of", "input_price")
    seen = rows.select("sku", F.col("as_of").alias("seen"), F.col("input_price").alias("then"))
    out = rows.withColumn("week_ago", F.date_sub("as_of", 7)).withColumn("month_ago", dates.prior_month(F.col("as_of")))
    out = merging.as_of(out, seen, ["sku"], "week_ago", "seen", ["then"]).withColumn("change_7d", F.col("input_price") - F.col("then")).drop("seen", "then")
    out = merging.as_of(out, seen, ["sku"], "month_ago", "seen", ["then"]).withColumn("change_month", F.col("input_price") - F.col("then"))
    return out.select("sku", "as_of", "input_price", "change_7d", "change_month")


@query(f"""WITH {_OBS}, g AS (SELECT *, observed BETWEEN DATE '1995-03-15' - INTERVAL 1 YEAR AND DATE '1995-03-15' AS recent, seq % 3 = 0 AS fixed, (seq % 7)::DOUBLE AS coupon FROM obs WHERE kind = 'F'),
a AS (SELECT company, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, count(*) FILTER (WHERE recent) AS n_recent, CAST(coalesce(sum(cents) FILTER (WHERE recent), 0) AS BIGINT) AS total_recent, max(observed) AS latest, count(*) FILTER (WHERE fixed) AS n_fixed, round(sum(CAST(cents AS DOUBLE) * coupon) FILTER (WHERE fixed) / sum(cents) FILTER (WHERE fixed), 6) AS coupon,
  CASE WHEN count(*) > 1 THEN CAST(round((max(observed) - min(observed)) * 1.0::DOUBLE / (count(*) - 1)) AS BIGINT) END AS mean_gap FROM g GROUP BY ROLLUP (company))
SELECT *, CASE WHEN mean_gap > 0 THEN round(365.0::DOUBLE / mean_gap, 6) END AS a_year FROM a""")
def capital_summary(spark, sf_dir):
    """Counts and sums, all and of the twelve months before a day, mean gap in days, how often a year, and the amount-weighted fixed coupon, for each company and overall. The gaps of a sorted series add up to last less first."""
    now = F.lit("1995-03-15").cast("date")
    c = F.col
    rows = observations(spark, sf_dir).where("kind = 'F'").withColumns({"recent": c("observed").between(F.add_months(now, -12), now), "fixed": c("seq") % 3 == 0, "rate": (c("seq") % 7).cast("double")})
    weight = F.sum(F.when(c("fixed"), c("cents")))
    out = rows.rollup("company").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cents").alias("total"),
        F.count_if("recent").alias("n_recent"),
        F.coalesce(F.sum(F.when(c("recent"), c("cents"))), F.lit(0)).alias("total_recent"),
        F.max("observed").alias("latest"),
        F.count_if("fixed").alias("n_fixed"),
        F.round(F.sum(F.when(c("fixed"), c("cents").cast("double") * c("rate"))) / weight, 6).alias("coupon"),
        F.when(F.count(F.lit(1)) > 1, F.round(F.datediff(F.max("observed"), F.min("observed")) / (F.count(F.lit(1)) - 1)).cast("long")).alias("mean_gap"),
    )
    return out.withColumn("a_year", F.when(c("mean_gap") > 0, F.round(365.0 / c("mean_gap"), 6)))


@query("""WITH m AS (SELECT p_type AS metric, p_brand AS vendor, max(p_retailprice) AS score, p_type LIKE 'S%' AS lower FROM part GROUP BY 1, 2),
b AS (SELECT metric, count(DISTINCT vendor) AS n_vendors, CASE WHEN bool_and(lower) THEN min(score) ELSE max(score) END AS best FROM m GROUP BY 1)
SELECT metric, n_vendors, n_vendors >= 2 AS comparable, best, string_agg(vendor, ',' ORDER BY vendor) AS winners FROM b JOIN m USING (metric) WHERE score = best GROUP BY ALL""")
def metric_winners(spark, sf_dir):
    """Of each metric the vendors with the best value, lower or higher, ties together."""
    rows = t.read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("metric"), F.col("p_brand").alias("vendor")).agg(F.max("p_retailprice").alias("score"))
    lower = F.col("metric").startswith("S")
    best = rows.groupBy("metric").agg(F.count_distinct("vendor").alias("n_vendors"), F.min("score").alias("lo"), F.max("score").alias("hi")).withColumn("best", F.when(lower, F.col("lo")).otherwise(F.col("hi")))
    hit = rows.join(best, "metric").where("score = best").groupBy("metric", "n_vendors", "best").agg(F.array_join(F.sort_array(F.collect_list("vendor")), ",").alias("winners"))
    return hit.select("metric", "n_vendors", (F.col("n_vendors") >= 2).alias("comparable"), "best", "winners")


@query("""SELECT p_brand AS brand, median(p_size) AS middle, list_sort(list(p_size))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_middle,
 CASE WHEN count(DISTINCT p_size) = 1 THEN max(p_size) END AS only_size FROM part GROUP BY 1""")
def medians(spark, sf_dir):
    """Mean and upper middle value, and the value if all agree.

    Rows are counted by (brand, value) before they move, so a brand with most rows costs one row a distinct value.
    """
    counts = t.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), "p_size").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("brand")
    rows = counts.withColumn("upto", F.sum("c").over(w.orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("p_size")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    return rows.groupBy("brand").agg(((low + high) / 2).alias("middle"), high.alias("upper_middle"), F.when(F.count(F.lit(1)) == 1, F.max("p_size")).alias("only_size"))


@query("""WITH c AS (SELECT l_orderkey AS task, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(round(l_quantity * 100) AS BIGINT) * CAST(round(l_extendedprice * 100) AS BIGINT) END AS units FROM lineitem)
SELECT task, count(*) AS n, count(units) AS disclosed, CAST(sum(units) AS BIGINT) / 10000000000.0::DOUBLE AS disclosed_cost, CASE WHEN count(units) = count(*) THEN CAST(sum(units) AS BIGINT) / 10000000000.0::DOUBLE END AS full_cost FROM c GROUP BY 1""")
def task_costs(spark, sf_dir):
    """Sum of the parts disclosed at a price per million, null if none; the whole only if all parts are known."""
    units = F.when(F.col("l_linenumber") % 3 != 0, t.cents("l_quantity") * t.cents("l_extendedprice"))
    out = t.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), units.alias("units")).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count("units").alias("disclosed"), F.sum("units").alias("units"))
    cost = F.col("units") / 10_000_000_000.0
    return out.select("task", "n", "disclosed", cost.alias("disclosed_cost"), F.when(F.col("n") == F.col("disclosed"), cost).alias("full_cost"))


@query(f"""WITH {_PRICES}, r AS (SELECT sku, as_of, input_price, row_number() OVER (PARTITION BY sku ORDER BY as_of DESC) AS rn FROM p),
l AS (SELECT sku, max(CASE WHEN rn = 1 THEN as_of END) AS as_of, max(CASE WHEN rn = 1 THEN input_price END) AS price, max(CASE WHEN rn = 2 THEN input_price END) AS before FROM r GROUP BY 1)
SELECT sku, as_of, price, round(100 * (price - before) / before, 6) AS move_pct,
 CAST((SELECT count(*) FROM range(as_of + INTERVAL 1 DAY, DATE '2001-12-02'::TIMESTAMP, INTERVAL 1 DAY) x(d) WHERE isodow(d) < 6) AS BIGINT) AS days_old FROM l""")
def product_moves(spark, sf_dir):
    """Last price, its move, and its age in business days."""
    w = Window.partitionBy("sku").orderBy(F.col("as_of").desc())
    rows = prices(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    last = rows.groupBy("sku").agg(*[F.max(F.when(F.col("rn") == n, F.col(c))).alias(a) for n, c, a in ((1, "as_of", "as_of"), (1, "input_price", "price"), (2, "input_price", "before"))])
    age = dates.business_days(F.col("as_of"), F.lit("2001-12-01").cast("date")).cast("long")
    return last.select("sku", "as_of", "price", F.round(F.try_divide(100 * (F.col("price") - F.col("before")), F.col("before")), 6).alias("move_pct"), age.alias("days_old"))


@query("""WITH m AS (SELECT event_type AS model, CAST(round(sum(value) * 1000) / 1000 AS DOUBLE) AS tokens FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT model, round(tokens, 2) AS tokens FROM m ORDER BY tokens DESC, model LIMIT 3""")
def top_models(spark, sf_dir):
    """Largest by sum, ties by name, one kind left out."""
    rows = t.read(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("model")).agg(F.sum("value").alias("tokens"))
    return rows.select("model", F.round("tokens", 2).alias("tokens")).orderBy(F.col("tokens").desc(), "model").limit(3)


@query(f"""WITH {_OBS}, d AS (SELECT DISTINCT observed FROM obs), s AS (SELECT CAST(DATE '1998-06-01' - INTERVAL (i) DAY AS DATE) AS day FROM range(14) x(i)) SELECT day FROM s WHERE day NOT IN (SELECT observed FROM d)""")
def missing_days(spark, sf_dir):
    """Which of the last 14 days lack a row."""
    end = F.lit("1998-06-01").cast("date")
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, 13), end)).alias("day"))
    return days.join(observations(spark, sf_dir).select(F.col("observed").alias("day")), "day", "left_anti")


#: A sample curve: years and zero rates.
CURVE = np.array([[0.25, 0.041], [1, 0.039], [3, 0.037], [5, 0.036], [10, 0.038]])


@query()
def credit_spreads(spark, sf_dir):
    """Spread of each quoted contract, and how well it gives the price back."""
    lines = t.read(spark, sf_dir, "lineitem")
    quotes = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (100.5 - F.col("l_discount") * 40).alias("price"), F.lit(0.01).alias("coupon"), (4.5 + F.col("l_linenumber") / 7).alias("years"))
    return credit.add_spreads(quotes, CURVE).withColumn("publishable", F.abs("residual") < 0.001)


@query()
def implied_spreads(spark, sf_dir):
    """M5: the spread that each trade's upfront implies, of both signs the one nearer to the reference."""
    c = F.col
    lines = t.read(spark, sf_dir, "lineitem")
    trades = lines.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.lit(100.0).alias("coupon_bp"), (c("l_tax") / 2).alias("upfront"), (1 + c("l_linenumber").cast("double")).alias("years"), F.when(c("l_linenumber") != 3, c("l_discount") * 5000).alias("reference_bp"))
    return credit.add_implied(trades)


_COSTED = """r AS (SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS run, l_partkey AS model, CASE l_linenumber % 3 WHEN 1 THEN 'standard' WHEN 2 THEN 'long' END AS context_tier, CASE WHEN l_suppkey % 4 = 0 THEN 'priority' WHEN l_suppkey % 4 = 1 THEN 'standard' END AS service_tier,
  CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) * 5 AS run_day, CASE WHEN l_linenumber <> 7 THEN CAST(round(l_quantity * 1000) AS BIGINT) END AS input_tokens, CASE WHEN l_suppkey % 10 <> 9 THEN l_partkey ELSE -1 END AS cached_tokens, CAST(round(l_tax * 100000) AS BIGINT) AS output_tokens FROM lineitem),
pr AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS model, coalesce(CASE l_suppkey % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'standard' END, 'standard') AS context_tier, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'priority' END, 'standard') AS service_tier, CAST(l_shipdate AS DATE) AS as_of,
  l_extendedprice / l_quantity AS input_rate, l_discount AS cached_rate, l_tax * 100 AS output_rate, CASE WHEN l_linenumber = 5 THEN '' ELSE ' usd' END AS currency FROM lineitem WHERE l_linenumber <> 6)"""


@query(f"""WITH {_COSTED}, best AS (SELECT rid, p.* EXCLUDE (model, context_tier, service_tier), row_number() OVER (PARTITION BY rid ORDER BY p.as_of DESC, seq, input_rate, cached_rate, output_rate) AS place FROM r JOIN pr p ON p.model = r.model AND (r.context_tier IS NULL OR r.context_tier = p.context_tier) AND (r.service_tier IS NULL OR r.service_tier = p.service_tier) AND p.as_of <= run_day),
j AS (SELECT r.*, b.* EXCLUDE (rid), input_tokens IS NOT NULL AND cached_tokens >= 0 AND output_tokens >= 0 AS known, trim(currency) <> '' AS priced FROM r LEFT JOIN best b ON b.rid = r.rid AND place = 1),
s AS (SELECT *, CASE WHEN NOT known THEN 'tokens_unavailable' WHEN coalesce(priced, false) THEN 'ready' ELSE 'price_unavailable' END AS status FROM j),
c AS (SELECT run, status, CASE WHEN status = 'ready' THEN as_of END AS price_as_of, CASE WHEN status = 'ready' THEN round(input_tokens / 1000000.0::DOUBLE * input_rate, 12) END AS input_cost, CASE WHEN status = 'ready' THEN round(cached_tokens / 1000000.0::DOUBLE * cached_rate, 12) END AS cached_cost, CASE WHEN status = 'ready' THEN round(output_tokens / 1000000.0::DOUBLE * output_rate, 12) END AS output_cost FROM s)
SELECT *, round(input_cost + cached_cost + output_cost, 12) AS total_cost FROM c""")
def costed_runs(spark, sf_dir):
    """Each run at the newest price of its model not after it, of the tiers that the run states, in three parts to twelve places; why there is no cost otherwise."""
    c, line = F.col, F.col("l_linenumber")
    lines = t.read(spark, sf_dir, "lineitem")
    runs = lines.select(
        (c("l_orderkey") * 10 + line).alias("run"), c("l_partkey").alias("model"), F.when(line % 3 == 1, "standard").when(line % 3 == 2, "long").alias("context_tier"), F.when(c("l_suppkey") % 4 == 0, "priority").when(c("l_suppkey") % 4 == 1, "standard").alias("service_tier"), F.date_add(F.to_date("l_shipdate"), line.cast("int") * 5).alias("run_day"),
        F.when(line != 7, F.round(c("l_quantity") * 1000).cast("long")).alias("input_tokens"), F.when(c("l_suppkey") % 10 != 9, c("l_partkey")).otherwise(-1).alias("cached_tokens"), F.round(c("l_tax") * 100_000).cast("long").alias("output_tokens"),
    )
    listed = lines.select(
        (c("l_orderkey") * 10 + line).alias("seq"), c("l_partkey").alias("model"), F.when(c("l_suppkey") % 3 == 0, "long").when(c("l_suppkey") % 3 == 1, "standard").alias("context_tier"), F.when(line % 2 == 0, "priority").alias("service_tier"), F.to_date("l_shipdate").alias("as_of"),
        (c("l_extendedprice") / c("l_quantity")).alias("input_rate"), c("l_discount").alias("cached_rate"), (c("l_tax") * 100).alias("output_rate"), F.when(line == 5, "").otherwise(" usd").alias("currency"), F.when(line == 6, "per_image").otherwise("per_million_tokens").alias("unit"),
    )
    return costs.attach(runs, listed).select("run", "status", "price_as_of", "input_cost", "cached_cost", "output_cost", "total_cost")


@query("""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_tax / 10 AS residual, l_extendedprice / 1000 AS spread, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice / 1000 * (1 + (l_discount - 0.05) / 4) END AS official FROM lineitem),
x AS (SELECT *, abs(spread - official) AS gap, abs(spread - official) / official AS share FROM q), s AS (SELECT *, CASE WHEN residual > 0.005 THEN 'needs-review' WHEN official IS NULL THEN 'model-derived' WHEN share <= 0.01 AND gap <= least(2.0, official * 0.01) THEN 'validated' ELSE 'needs-review' END AS status FROM x)
SELECT id, status, status <> 'needs-review' AS publishable, round(share, 9) AS relative_error FROM s""")
def credit_quality(spark, sf_dir):
    """M7: whether a spread may be published: by how far its price is missed, and how near it is to an official one."""
    k, spread = F.col("l_linenumber"), F.col("l_extendedprice") / 1000
    official = F.when(k % 3 > 0, spread * (1 + (F.col("l_discount") - 0.05) / 4))
    rows = t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("id"), credit.quality(F.col("l_tax") / 10, spread, official).alias("q"))
    return rows.select("id", "q.status", "q.publishable", F.round("q.relative_error", 9).alias("relative_error"))
