"""Market breadth, turnover concentration and margin queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import merging, ranking, validate, windows
from tickloom.plans.register import query
from tickloom.sources import tables as t


@query(f"""WITH {t.BARS}, live AS (
  SELECT date, cents, row_number() OVER (PARTITION BY date ORDER BY cents DESC, code) AS place, count(*) OVER (PARTITION BY date) AS n FROM bars WHERE cents > 0),
days AS (SELECT date, max(n) AS n_codes, CAST(sum(cents) AS BIGINT) AS total,
  CAST(max(greatest(1, ceil(n * 1 / 100.0))) AS BIGINT) AS top1_count, CAST(max(greatest(1, ceil(n * 3 / 100.0))) AS BIGINT) AS top3_count, CAST(max(greatest(1, ceil(n * 5 / 100.0))) AS BIGINT) AS top5_count,
  CAST(sum(CASE WHEN place <= greatest(1, ceil(n * 1 / 100.0)) THEN cents ELSE 0 END) AS BIGINT) AS top1_amount,
  CAST(sum(CASE WHEN place <= greatest(1, ceil(n * 3 / 100.0)) THEN cents ELSE 0 END) AS BIGINT) AS top3_amount,
  CAST(sum(CASE WHEN place <= greatest(1, ceil(n * 5 / 100.0)) THEN cents ELSE 0 END) AS BIGINT) AS top5_amount FROM live GROUP BY date),
p AS (SELECT *, top1_amount * 100.0::DOUBLE / total AS top1_pct, top3_amount * 100.0::DOUBLE / total AS top3_pct, top5_amount * 100.0::DOUBLE / total AS top5_pct FROM days),
r AS (SELECT *, 100.0::DOUBLE * count(*) OVER (ORDER BY top1_pct RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS top1_rank,
  100.0::DOUBLE * count(*) OVER (ORDER BY top3_pct RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS top3_rank,
  100.0::DOUBLE * count(*) OVER (ORDER BY top5_pct RANGE UNBOUNDED PRECEDING) / count(*) OVER () AS top5_rank FROM p)
SELECT *, CASE WHEN greatest(top1_rank, top3_rank, top5_rank) >= 98 THEN 'danger' WHEN greatest(top1_rank, top3_rank, top5_rank) >= 95 THEN 'warning'
  WHEN greatest(top1_rank, top3_rank, top5_rank) >= 90 THEN 'warm' ELSE 'normal' END AS warning FROM r""")
def market_concentration(spark, sf_dir):
    """Turnover held by the largest 1, 3 and 5 % of codes a day, its percentile, and a warning."""
    days = ranking.concentration(t.daily_bars(spark, sf_dir), "date", "code", "cents")
    for p in (1, 3, 5):
        # one row for each day: a rank over all days is over few rows whatever the table's size
        days = days.withColumn(f"top{p}_rank", windows.percentile_rank(F.col(f"top{p}_pct"), Window.partitionBy().orderBy(f"top{p}_pct")))
    return days.withColumn("warning", ranking.warning(*[F.col(f"top{p}_rank") for p in (1, 3, 5)]))


@query(f"""WITH {t.BARS}, r AS (SELECT date, code, cents, row_number() OVER (PARTITION BY date ORDER BY cents DESC, code) AS rank, sum(cents) OVER (PARTITION BY date) AS total FROM bars WHERE cents > 0)
SELECT date, code, cents, rank, cents * 100.0::DOUBLE / total AS share_pct FROM r WHERE rank <= 10""")
def market_top_list(spark, sf_dir):
    """The ten largest codes of each day with rank and share."""
    bars = t.daily_bars(spark, sf_dir).where("cents > 0").select("date", "code", "cents")
    totals = bars.groupBy("date").agg(F.sum("cents").alias("total"))
    top = ranking.top_n(bars, ["date"], [F.col("cents").desc(), F.col("code")], 10)
    return top.join(totals, "date").select("date", "code", "cents", "rank", (F.col("cents") * 100.0 / F.col("total")).alias("share_pct"))


@query(f"""WITH {t.BARS} SELECT date, count(*) AS n_codes, CAST(sum(cents) AS BIGINT) AS cents FROM bars WHERE date >= DATE '1997-01-01' GROUP BY date HAVING count(*) >= 10""")
def market_long_history(spark, sf_dir):
    """A2: days since a start on which enough codes traded."""
    bars = t.daily_bars(spark, sf_dir).where("date >= date'1997-01-01'")
    return bars.groupBy("date").agg(F.count(F.lit(1)).alias("n_codes"), F.sum("cents").alias("cents")).where("n_codes >= 10")


@query(f"""WITH {t.MARGIN}, prev AS (SELECT date, code, industry, cents, lag(cents) OVER (PARTITION BY code ORDER BY date) AS before FROM margin),
bought AS (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS industry, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS buy FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1, 2), members AS (SELECT c_mktsegment AS industry, count(*) AS n_universe FROM customer GROUP BY 1),
g AS (SELECT date, industry, count(DISTINCT code) AS n_codes, CAST(sum(cents) AS BIGINT) AS balance, CAST(sum(cents - before) AS BIGINT) AS change FROM prev GROUP BY 1, 2)
SELECT date, industry, n_universe, n_codes, balance, coalesce(buy, 0) AS buy, change, balance * 100.0::DOUBLE / sum(balance) OVER (PARTITION BY date) AS market_pct,
 CASE WHEN industry IN ('BUILDING', 'MACHINERY') THEN balance * 100.0::DOUBLE / sum(CASE WHEN industry IN ('BUILDING', 'MACHINERY') THEN balance END) OVER (PARTITION BY date) END AS sector_pct FROM g JOIN members USING (industry) LEFT JOIN bought USING (date, industry)""")
def margin_by_industry(spark, sf_dir):
    """By day and industry members, codes, balances, purchases, changes on each code's previous day (null if none is known), and shares of the market and of the sector."""
    rows = t.margin_balances(spark, sf_dir)
    rows = rows.withColumn("change", F.col("cents") - F.lag("cents").over(windows.by(["code"])))
    out = rows.groupBy("date", "industry").agg(F.count_distinct("code").alias("n_codes"), F.sum("cents").alias("balance"), F.sum("change").alias("change"))
    customers = t.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("industry"))
    bought = t.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.to_date("o_orderdate").alias("date"), "industry").agg(F.sum(t.cents("o_totalprice")).alias("buy"))
    out = out.join(customers.groupBy("industry").agg(F.count(F.lit(1)).alias("n_universe")), "industry").join(bought, ["date", "industry"], "left")
    day, balance = Window.partitionBy("date"), F.col("balance")
    sector = F.when(F.col("industry").isin("BUILDING", "MACHINERY"), balance)
    return out.select("date", "industry", "n_universe", "n_codes", "balance", F.coalesce("buy", F.lit(0)).alias("buy"), "change", (balance * 100.0 / F.sum(balance).over(day)).alias("market_pct"), (sector * 100.0 / F.sum(sector).over(day)).alias("sector_pct"))


@query(f"""WITH {t.MARGIN}, d AS (SELECT date, CAST(sum(cents) AS BIGINT) AS market, CAST(sum(CASE WHEN industry IN ('BUILDING', 'MACHINERY') THEN cents ELSE 0 END) AS BIGINT) AS sector FROM margin GROUP BY 1),
l AS (SELECT date, market, sector, market - lag(market, 5) OVER (ORDER BY date) AS market_delta, sector - lag(sector, 5) OVER (ORDER BY date) AS sector_delta FROM d)
SELECT date, market, sector, sector * 100.0::DOUBLE / market AS sector_pct, CASE WHEN market_delta > 0 THEN sector_delta * 100.0::DOUBLE / market_delta END AS increment_pct FROM l""")
def margin_increment_share(spark, sf_dir):
    """A sector's share of the balance, and of its growth over five sessions where the market grew."""
    sector = F.col("industry").isin("BUILDING", "MACHINERY")
    days = t.margin_balances(spark, sf_dir).groupBy("date").agg(F.sum("cents").alias("market"), F.sum(F.when(sector, F.col("cents")).otherwise(0)).alias("sector"))
    w = Window.orderBy("date")  # one row for each day
    days = days.withColumn("dm", F.col("market") - F.lag("market", 5).over(w)).withColumn("ds", F.col("sector") - F.lag("sector", 5).over(w))
    return days.select("date", "market", "sector", (F.col("sector") * 100.0 / F.col("market")).alias("sector_pct"), F.when(F.col("dm") > 0, F.col("ds") * 100.0 / F.col("dm")).alias("increment_pct"))


@query(f"""WITH {t.MARGIN}, n AS (SELECT date, count(DISTINCT industry) AS n_industries, count(*) AS n_rows FROM margin GROUP BY 1)
SELECT date, n_industries, n_rows, n_industries = 5 AS complete FROM n""")
def margin_completeness(spark, sf_dir):
    """A5, V5: whether all industries are there on a day."""
    days = t.margin_balances(spark, sf_dir).groupBy("date").agg(F.count_distinct("industry").alias("n_industries"), F.count(F.lit(1)).alias("n_rows"))
    return days.withColumn("complete", F.col("n_industries") == 5)


@query(f"""WITH {t.BARS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM bars)
SELECT a.code, a.date, a.close, 100.0::DOUBLE * (a.close - b.close) / b.close AS pct,
  a.volume / (SELECT avg(c.volume) FROM ranked c WHERE c.code = a.code AND c.rn BETWEEN a.rn - 5 AND a.rn - 1 AND c.volume > 0) AS ratio
FROM ranked a LEFT JOIN ranked b ON b.code = a.code AND b.rn = a.rn - 1""")
def market_row_builder(spark, sf_dir):
    """Change on the previous bar, and volume against up to five earlier ones."""
    w = windows.by(["code"])
    return t.daily_bars(spark, sf_dir).select("code", "date", "close", (100.0 * (F.col("close") - F.lag("close").over(w)) / F.lag("close").over(w)).alias("pct"), windows.volume_ratio(F.col("volume"), 5, w).alias("ratio"))


@query(f"""WITH {t.BARS}, d AS (SELECT date, count(*) AS n, count(*) FILTER (WHERE volume >= 30) AS valid FROM bars GROUP BY 1), u AS (SELECT count(*) AS universe FROM supplier),
x AS (SELECT *, greatest(lag(valid) OVER (ORDER BY date), lead(valid) OVER (ORDER BY date)) AS beside FROM d, u),
f AS (SELECT date, n, valid, round(n * 1.0::DOUBLE / universe, 6) AS coverage, CASE WHEN beside > 0 THEN round(valid * 1.0::DOUBLE / beside, 6) END AS ratio, CASE WHEN n * 1.0::DOUBLE / universe < 0.2 THEN 'coverage' END AS a, CASE WHEN NOT coalesce(beside > 0, false) THEN 'no neighbours' WHEN valid * 1.0::DOUBLE / beside < 0.9 THEN 'neighbours' END AS b FROM x)
SELECT date, n, valid, coverage, ratio, concat_ws(',', a, b) AS failures, a IS NULL AND b IS NULL AS ok FROM f""")
def market_snapshot_gate(spark, sf_dir):
    """A day's rows against the universe, and its valid rows against the days beside it, with what fails."""
    days = t.daily_bars(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("volume") >= 30).alias("valid"))
    w = Window.orderBy("date")  # one row for each day
    days = days.withColumn("beside", F.array(F.lag("valid").over(w), F.lead("valid").over(w)))
    universe = t.read(spark, sf_dir, "supplier").count()
    gate = validate.snapshot_gate(F.col("n"), F.col("valid"), F.lit(universe), F.col("beside"), least_coverage=0.2)
    return days.select("date", "n", "valid", gate.alias("g")).select("date", "n", "valid", "g.coverage", "g.ratio", F.array_join("g.failures", ",").alias("failures"), (F.size("g.failures") == 0).alias("ok"))


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date FROM d WHERE date IN (SELECT date FROM o) ORDER BY date DESC LIMIT 20""")
def dates_in_both(spark, sf_dir):
    """Newest days that two feeds share."""
    a = t.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    b = t.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return a.join(b, "date", "left_semi").orderBy(F.col("date").desc()).limit(20)


@query("""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date FROM d WHERE date NOT IN (SELECT date FROM o) UNION SELECT max(date) FROM d""")
def dates_missing(spark, sf_dir):
    """Days of one feed that another lacks, and always the latest."""
    a = t.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    b = t.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return a.join(b, "date", "left_anti").unionByName(a.agg(F.max("date").alias("date"))).distinct()


@query("""WITH d AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
s AS (SELECT date FROM d UNION SELECT date FROM o) SELECT s.date, n, d.date IS NULL AS is_placeholder FROM s LEFT JOIN d ON s.date = d.date""")
def dates_spine(spark, sf_dir):
    """Every day of either feed, with placeholders."""
    rows = t.read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    days = t.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return merging.spine(days, rows, "date").select("date", "n", "is_placeholder")


@query(f"""WITH {t.BARS}, d AS (SELECT DISTINCT date FROM bars), x AS (SELECT date, lag(date) OVER (ORDER BY date) AS previous, lead(date) OVER (ORDER BY date) AS next, row_number() OVER (ORDER BY date DESC) - 1 AS sessions_after FROM d)
SELECT date, previous, next, sessions_after, date_diff('day', previous, date) AS gap_days FROM x""")
def trading_calendar(spark, sf_dir):
    """Neighbours of a session, sessions since, gap in days."""
    days = t.daily_bars(spark, sf_dir).select("date").distinct()
    w = Window.orderBy("date")
    after = F.row_number().over(Window.orderBy(F.col("date").desc())) - 1
    days = days.select("date", F.lag("date").over(w).alias("previous"), F.lead("date").over(w).alias("next"), after.cast("long").alias("sessions_after"))
    return days.withColumn("gap_days", F.datediff("date", "previous").cast("long"))


@query(f"""WITH {t.BARS}, r AS (SELECT n_name AS industry, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
SELECT date, industry, count(*) AS n_codes, CAST(sum(cents) AS BIGINT) AS cents FROM bars JOIN r ON code = s_suppkey GROUP BY 1, 2""")
def sector_turnover(spark, sf_dir):
    """Turnover of a sector's members by industry."""
    nations = t.read(spark, sf_dir, "nation").join(t.read(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    members = t.read(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"))
    return t.daily_bars(spark, sf_dir).join(members, "code").groupBy("date", "industry").agg(F.count(F.lit(1)).alias("n_codes"), F.sum("cents").alias("cents"))


@query("""SELECT l_returnflag AS source, CAST(l_shipdate AS DATE) AS date, count(*) AS n, count(DISTINCT l_suppkey) AS n_codes, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS unique_rows,
 bool_and(l_quantity > 0 AND l_extendedprice > 0) AS valid FROM lineitem GROUP BY 1, 2""")
def cross_section_gate(spark, sf_dir):
    """Row counts, uniqueness and positive values of each delivered cross-section."""
    rows = t.read(spark, sf_dir, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    return rows.groupBy(F.col("l_returnflag").alias("source"), "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("l_suppkey").alias("n_codes"),
        (F.count(F.lit(1)) == F.count_distinct("l_orderkey", "l_linenumber")).alias("unique_rows"),
        F.bool_and((F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0)).alias("valid"),
    )
