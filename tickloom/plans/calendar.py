"""Event calendars: overlap, day lists, aliases, order, validation, period changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import aliases, merging
from tickloom.plans.register import query
from tickloom.sources import tables as t

_EVENTS = """ev AS (SELECT o_orderkey AS id, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS first, max(CAST(l_shipdate AS DATE)) AS last, o_orderpriority AS importance FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def events(spark, sf_dir):
    """id, symbol, first, last (may lack), importance: an order from its date to its last shipping."""
    last = t.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("last"))
    orders = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("first"), F.col("o_orderpriority").alias("importance"))
    return orders.join(last, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey").select("id", "symbol", "first", "last", "importance")


@query(f"WITH {_EVENTS} SELECT * FROM ev WHERE first <= DATE '1997-03-31' AND coalesce(last, first) >= DATE '1997-03-01'")
def calendar_overlap(spark, sf_dir):
    """Events that meet a range."""
    return merging.overlapping(events(spark, sf_dir), "first", "last", F.lit("1997-03-01").cast("date"), F.lit("1997-03-31").cast("date"))


@query(f"""WITH {_EVENTS}, d AS (SELECT id, unnest(CASE WHEN last >= first AND last - first < 366 THEN generate_series(first, last, INTERVAL 1 DAY) ELSE [first::TIMESTAMP] END)::DATE AS day FROM ev) SELECT day, count(*) AS n, min(id) AS first_id FROM d GROUP BY 1""")
def calendar_days(spark, sf_dir):
    """Events under each of their days."""
    return merging.by_day(events(spark, sf_dir), "first", "last").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {_EVENTS} SELECT id, first, CASE WHEN importance NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'importance' WHEN last < first THEN 'reversed' WHEN last - first > 366 THEN 'too long' END AS fault FROM ev""")
def calendar_faults(spark, sf_dir):
    """The first rule that an event breaks."""
    ok = F.col("importance").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    fault = F.when(~ok, "importance").when(F.col("last") < F.col("first"), "reversed").when(F.datediff("last", "first") > 366, "too long")
    return events(spark, sf_dir).select("id", "first", fault.alias("fault"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1)
SELECT a.month, a.cents, round(100.0::DOUBLE * (a.cents - b.cents) / b.cents, 6) AS mom_pct, round(100.0::DOUBLE * (a.cents - y.cents) / y.cents, 6) AS yoy_pct FROM m a
LEFT JOIN m b ON b.month = a.month - INTERVAL 1 MONTH LEFT JOIN m y ON y.month = a.month - INTERVAL 1 YEAR""")
def period_changes(spark, sf_dir):
    """Change on the month and the year before, null where they lack."""
    m = t.read(spark, sf_dir, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(t.cents("o_totalprice")).alias("cents"))

    def before(n, name):
        return m.select(F.add_months("month", n).alias("month"), F.col("cents").alias(name))

    out = m.join(before(1, "b"), "month", "left").join(before(12, "y"), "month", "left")
    pct = lambda c: F.round(100.0 * (F.col("cents") - F.col(c)) / F.col(c), 6)
    return out.select("month", "cents", pct("b").alias("mom_pct"), pct("y").alias("yoy_pct"))


@query("""WITH r AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT id, date, place FROM r WHERE place <= 3""")
def calendar_order(spark, sf_dir):
    """The first three of each day by importance, size, id."""
    w = Window.partitionBy("date").orderBy("o_orderpriority", F.col("o_totalprice").desc(), "id")
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_totalprice")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("id", "date", "place")


#: Companies with several symbols: each seventh has the one before it for canonical, and that one the one before.
_ALIAS = """al AS (SELECT 'S' || s_suppkey AS alias, 'S' || (s_suppkey - 1) AS canonical FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT 'S' || s_suppkey, 'S' || (s_suppkey - 2) FROM supplier WHERE s_suppkey % 7 = 6),
ends AS (SELECT a.alias, coalesce(b.canonical, a.canonical) AS canonical FROM al a LEFT JOIN al b ON b.alias = a.canonical),
ue AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS period, o_orderstatus = 'F' AS earnings, CASE o_orderkey % 4 WHEN 0 THEN '$s' WHEN 1 THEN 'us:S' WHEN 2 THEN ' S' ELSE 's' END || (o_custkey // 10) AS raw, 'S' || (o_custkey // 10) AS symbol FROM orders),
uc AS (SELECT ue.*, coalesce(canonical, symbol) AS canonical FROM ue LEFT JOIN ends ON alias = symbol)"""


def company_aliases(spark, sf_dir):
    k = F.col("s_suppkey")
    name = lambda n: F.concat(F.lit("S"), n.cast("string"))
    rows = t.read(spark, sf_dir, "supplier")
    given = rows.where(k % 7 == 0).select(name(k).alias("alias"), name(k - 1).alias("canonical")).unionByName(rows.where(k % 7 == 6).select(name(k).alias("alias"), name(k - 2).alias("canonical")))
    return aliases.closed(given)


def earnings_events(spark, sf_dir):
    """id, date, period, earnings (or another kind), symbol as it was written."""
    k = F.col("o_orderkey")
    before = F.when(k % 4 == 0, "$s").when(k % 4 == 1, "us:S").when(k % 4 == 2, " S").otherwise("s")
    raw = F.concat(before, F.floor(F.col("o_custkey") / 10).cast("string"))
    rows = t.read(spark, sf_dir, "orders").select(k.alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("period"), (F.col("o_orderstatus") == "F").alias("earnings"), aliases.us_symbol(raw).alias("symbol"))
    return aliases.canonical(rows, company_aliases(spark, sf_dir), "symbol", "canonical")


@query(f"""WITH {_ALIAS}, p AS (SELECT n_name AS fund, 'S' || s_suppkey AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3 AND s_suppkey % 11 <> 0 UNION ALL SELECT r_name, 'S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 11 <> 0),
h AS (SELECT DISTINCT fund, coalesce(canonical, symbol) AS canonical FROM p LEFT JOIN ends ON alias = symbol), l AS (SELECT canonical, count(*) AS n, string_agg(fund, ',' ORDER BY fund) AS funds FROM h GROUP BY 1)
SELECT id, uc.symbol, uc.canonical, coalesce(n, 0) AS n_hits, coalesce(funds, '') AS hits FROM uc LEFT JOIN l ON l.canonical = uc.canonical WHERE earnings""")
def fund_hits(spark, sf_dir):
    """The funds that hold the company of an earnings event under any of its symbols, once each, by the order of their names; funds of other markets and positions that are no companies don't count."""
    key = F.col("s_suppkey")
    held = t.read(spark, sf_dir, "supplier").join(t.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    markets = F.array(F.struct(F.col("n_name").alias("fund"), F.when(F.col("n_nationkey") % 4 == 3, "hk").otherwise("us").alias("market")), F.struct(F.col("r_name").alias("fund"), F.lit("us").alias("market")))
    symbol = F.concat(F.lit("us:s"), key.cast("string"))
    kept = held.select(F.explode(markets).alias("f"), aliases.us_symbol(symbol).alias("symbol"), F.when(key % 11 == 0, "etf").otherwise("stock").alias("kind")).where("f.market = 'us'")
    kept = kept.where(~text.no_company(F.col("symbol"), F.col("kind"), F.lit("name"), [])).select("f.fund", "symbol")
    hits = aliases.canonical(kept, company_aliases(spark, sf_dir), "symbol", "canonical").select("fund", "canonical").distinct()
    hits = hits.groupBy("canonical").agg(aliases.in_order(F.collect_list("fund"), "zh").alias("funds"))
    events = earnings_events(spark, sf_dir).where("earnings").join(hits, "canonical", "left")
    return events.select("id", "symbol", "canonical", F.coalesce(F.size("funds"), F.lit(0)).cast("long").alias("n_hits"), F.coalesce(F.array_join("funds", ","), F.lit("")).alias("hits"))


@query(f"""WITH {_ALIAS}, known AS (SELECT DISTINCT canonical FROM ends), x AS (SELECT uc.*, CASE WHEN earnings AND known.canonical IS NOT NULL THEN uc.canonical || '|' || date || '|' || period ELSE id::VARCHAR END AS key FROM uc LEFT JOIN known ON known.canonical = uc.canonical)
SELECT any_value(canonical) AS canonical, any_value(date) AS date, count(*) AS n, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, arg_min(id, (CASE WHEN symbol = canonical THEN 0 ELSE 1 END, id)) AS id FROM x GROUP BY key""")
def calendar_aliases(spark, sf_dir):
    """Earnings of one company, day and period under several symbols become one event, the canonical symbol's first, with all symbols; other events stay."""
    known = company_aliases(spark, sf_dir).select("canonical").distinct().withColumn("known", F.lit(True))
    rows = earnings_events(spark, sf_dir).join(known, "canonical", "left")
    key = F.when(F.col("earnings") & F.col("known"), F.concat_ws("|", "canonical", "date", "period")).otherwise(F.col("id").cast("string"))
    first = F.struct(F.col("symbol") != F.col("canonical"), "id")
    out = rows.groupBy(key.alias("key")).agg(F.min("canonical").alias("canonical"), F.min("date").alias("date"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"), F.min_by("id", first).alias("id"))
    return out.drop("key")
