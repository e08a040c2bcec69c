"""Further queries: turning points, interpolation, matching, slices, classifiers, chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import disclosures, merging, ranking, windows
from tickloom.plans.dashboard import prices
from tickloom.plans.dashboard import _PRICES as PRICES_SQL
from tickloom.plans.filings import _SCORED as SCORED_SQL
from tickloom.plans.filings import scored
from tickloom.plans.register import query
from tickloom.sources import tables as t


@query(f"""WITH {t.BARS}, l AS (SELECT code, date, close AS v0, lag(close, 1) OVER w AS v1, lag(close, 2) OVER w AS v2, lag(close, 3) OVER w AS v3, lag(close, 4) OVER w AS v4 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, coalesce(v1 < v2 AND v0 > v1, false) AS basic, coalesce(v3 < v4 AND v2 < v3 AND v1 > v2 AND v0 > v1, false) AS advanced, coalesce(v1 < v2 AND v0 - v1 >= 0.5 * (v2 - v1), false) AS strong FROM l""")
def turning_points(spark, sf_dir):
    """A fall then a rise of the close over three and five bars, and a rise of at least half the fall."""
    w = windows.by(["code"])
    v = [F.col("close"), *[F.lag("close", i).over(w) for i in range(1, 5)]]
    no = F.lit(False)
    return t.daily_bars(spark, sf_dir).select(
        "code",
        "date",
        F.coalesce((v[1] < v[2]) & (v[0] > v[1]), no).alias("basic"),
        F.coalesce((v[3] < v[4]) & (v[2] < v[3]) & (v[1] > v[2]) & (v[0] > v[1]), no).alias("advanced"),
        F.coalesce((v[1] < v[2]) & (v[0] - v[1] >= 0.5 * (v[2] - v[1])), no).alias("strong"),
    )


@query("""WITH m AS (SELECT p_brand AS brand, date_trunc('month', l_shipdate)::DATE AS month, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
a AS (SELECT *, lead(month) OVER w AS next, lead(price) OVER w AS later FROM m WINDOW w AS (PARTITION BY brand ORDER BY month)),
d AS (SELECT *, unnest(generate_series(month, next - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM a WHERE next IS NOT NULL)
SELECT brand, day, round(price + (later - price) * date_diff('day', month, day) / date_diff('day', month, next), 6) AS price FROM d WHERE isodow(day) < 6""")
def interpolated_days(spark, sf_dir):
    """Business days on the line between the monthly prices of each brand."""
    lines = t.read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.trunc("l_shipdate", "month").alias("month"), t.cents("l_extendedprice").alias("cents"))
    brands = t.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    months = lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).groupBy("brand", "month").agg((F.sum("cents") / 100.0 / F.sum("l_quantity")).alias("price"))
    w = Window.partitionBy("brand").orderBy("month")  # one row for each brand and month
    a = months.select("brand", "month", "price", F.lead("month").over(w).alias("next"), F.lead("price").over(w).alias("later")).where("next is not null")
    d = a.withColumn("day", F.explode(F.sequence("month", F.date_sub("next", 1)))).where(F.weekday("day") < 5)
    return d.select("brand", "day", F.round(F.col("price") + (F.col("later") - F.col("price")) * F.datediff("day", "month") / F.datediff("next", "month"), 6).alias("price"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_suppkey, 4 + l_linenumber / 4.0 AS tenor, l_tax AS coupon FROM lineitem), h AS (SELECT l_suppkey, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM c WHERE tenor BETWEEN 4.5 AND 5.5 AND coupon <= 0.04)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, max(l_suppkey) FILTER (WHERE n = 1) AS supplier FROM orders LEFT JOIN h ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def contract_match(spark, sf_dir):
    """Contracts within a tenor range: exactly one, none, or several."""
    c = t.read(spark, sf_dir, "lineitem").where((4 + F.col("l_linenumber") / 4.0).between(4.5, 5.5) & (F.col("l_tax") <= 0.04))
    h = c.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_suppkey").alias("supplier"))
    outcome = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    joined = t.read(spark, sf_dir, "orders").select("o_orderkey").join(h, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("supplier")).alias("supplier"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem a WHERE l_returnflag <> 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R')""")
def valid_trades(spark, sf_dir):
    """Rows of a trade that was cancelled anywhere leave."""
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    gone = lines.where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return lines.where("l_returnflag <> 'R'").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"""WITH {PRICES_SQL} SELECT sku, max(as_of) AS as_of, arg_max(input_price, as_of) AS price FROM p WHERE as_of <= DATE '1998-06-30' GROUP BY 1""")
def curve_as_of(spark, sf_dir):
    """Of each key the last row on or before a date."""
    return prices(spark, sf_dir).where(F.col("as_of") <= F.lit("1998-06-30").cast("date")).groupBy("sku").agg(F.max("as_of").alias("as_of"), F.max_by("input_price", "as_of").alias("price"))


@query(f"""WITH {t.BARS}, s AS (SELECT DISTINCT date, code FROM bars WHERE volume >= 40), d AS (SELECT DISTINCT date FROM s), today AS (SELECT DISTINCT s_suppkey AS code FROM supplier WHERE s_acctbal > 0)
SELECT b.date, b.code, CASE WHEN d.date IS NOT NULL THEN 'snapshot' ELSE 'backfill' END AS basis FROM bars b LEFT JOIN d ON b.date = d.date LEFT JOIN s ON s.date = b.date AND s.code = b.code LEFT JOIN today n ON n.code = b.code
WHERE CASE WHEN d.date IS NOT NULL THEN s.code IS NOT NULL ELSE n.code IS NOT NULL END""")
def point_in_time_members(spark, sf_dir):
    """Members of the day if the day has a list, else of today's, and which it was."""
    bars = t.daily_bars(spark, sf_dir).select("date", "code", "volume")
    member = F.col("volume") >= 40
    bars = bars.withColumn("listed", F.max(member).over(Window.partitionBy("date"))).withColumn("member", member)
    now = t.read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), F.lit(True).alias("now")).distinct()
    rows = bars.join(now, "code", "left").where("CASE WHEN listed THEN member ELSE now END")
    return rows.select("date", "code", F.when(F.col("listed"), "snapshot").otherwise("backfill").alias("basis"))


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, r AS (SELECT date, close, row_number() OVER (ORDER BY date) - 1 AS i FROM bench) SELECT date, close FROM r WHERE i % 20 = 0 ORDER BY date DESC LIMIT 240""")
def sampled_curve(spark, sf_dir):
    """Every twentieth point of a curve, the last 240."""
    rows = t.benchmark(spark, sf_dir).select("date", "close").withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    return rows.where("i % 20 = 0").orderBy(F.col("date").desc()).limit(240).select("date", "close")


@query(f"""WITH {SCORED_SQL}, g AS (SELECT code, max(score) AS score FROM scored GROUP BY 1), f AS (SELECT code FROM g ORDER BY score DESC, code LIMIT 30)
SELECT n_name AS sector, count(*) AS n FROM f JOIN supplier ON code = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, sector LIMIT 5""")
def leading_sectors(spark, sf_dir):
    """A10: sectors of the first thirty companies, the five most frequent."""
    first = scored(spark, sf_dir).groupBy("code").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "code").limit(30)
    named = t.read(spark, sf_dir, "supplier").join(F.broadcast(t.read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("sector"))
    return first.join(named, "code").groupBy("sector").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "sector").limit(5)


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS slot FROM events), l AS (SELECT * FROM e WHERE day = (SELECT max(day) FROM e))
SELECT slot, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY event_type <> 'purchase', ts, event_id) AS rn FROM l) WHERE rn = 1""")
def latest_day_slots(spark, sf_dir):
    """The latest day, one row for each slot: the preferred kind, else the first seen."""
    rows = t.read(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("slot", F.date_trunc("hour", "ts"))
    last = rows.agg(F.max("day").alias("day"))
    rows = rows.join(F.broadcast(last), "day")
    return merging.pick(rows, ["slot"], [F.col("event_type") != "purchase", F.col("ts"), F.col("event_id")]).select("slot", "event_id", "event_type", "value")


@query(f"""WITH {t.BARS}, h AS (SELECT code, count(*) AS n FROM bars GROUP BY 1) SELECT count(*) AS eligible, count(*) FILTER (WHERE n >= 252) AS cached, count(*) FILTER (WHERE n IS NULL) AS missing,
 round(count(*) FILTER (WHERE n >= 252) * 1.0 / count(*), 6) AS coverage, count(*) FILTER (WHERE n >= 252) = count(*) AS ready FROM supplier LEFT JOIN h ON code = s_suppkey""")
def coverage_status(spark, sf_dir):
    """How much of the universe has enough history, and whether all has."""
    h = t.daily_bars(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rows = t.read(spark, sf_dir, "supplier").select("s_suppkey").join(h, F.col("s_suppkey") == F.col("code"), "left")
    out = rows.agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("n") >= 252).alias("cached"), F.count_if(F.col("n").isNull()).alias("missing"))
    return out.select("eligible", "cached", "missing", F.round(F.col("cached") * 1.0 / F.col("eligible"), 6).alias("coverage"), (F.col("cached") == F.col("eligible")).alias("ready"))


@query(f"""WITH {t.BARS}, l AS (SELECT code, date, close, volume, lag(close) OVER w AS before, avg(volume) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
s AS (SELECT code, date, CASE WHEN close > before THEN 2 ELSE 0 END + CASE WHEN volume > base THEN 1 ELSE 0 END AS score FROM l WHERE rn = 1)
SELECT code, date, score, CASE WHEN score >= 3 THEN 'strong' WHEN score >= 2 THEN 'candidate' WHEN score >= 1 THEN 'watch' ELSE 'none' END AS level FROM s""")
def screener_levels(spark, sf_dir):
    """Weighted score of the last bar, and its level."""
    w = windows.by(["code"])
    rows = t.daily_bars(spark, sf_dir).select("code", "date", "close", "volume", F.lag("close").over(w).alias("before"), F.avg("volume").over(w.rowsBetween(-5, -1)).alias("base"), F.row_number().over(Window.partitionBy("code").orderBy(F.col("date").desc())).alias("rn")).where("rn = 1")
    score = F.when(F.col("close") > F.col("before"), 2).otherwise(0) + F.when(F.col("volume") > F.col("base"), 1).otherwise(0)
    level = F.when(score >= 3, "strong").when(score >= 2, "candidate").when(score >= 1, "watch").otherwise("none")
    return rows.select("code", "date", score.alias("score"), level.alias("level"))


@query("""WITH d AS (SELECT doc_id, text, source, CASE WHEN source IN ('src0', 'src1') THEN 3 WHEN source IN ('src2', 'src3') THEN 2 ELSE 1 END AS tier FROM documents),
s AS (SELECT doc_id, tier, (contains(text, 'the'))::INT * 5 + (contains(text, 'die'))::INT * 4 + (contains(text, 'les'))::INT * 3 + (contains(text, 'que'))::INT * 2 AS points FROM d)
SELECT doc_id, tier, points * tier AS score, points * tier >= CASE tier WHEN 3 THEN 12 WHEN 2 THEN 10 ELSE 5 END AS passed FROM s""")
def tiered_scores(spark, sf_dir):
    """keyword points times the tier of the source, with a limit for each tier."""
    c = F.col("text")
    tier = F.when(F.col("source").isin("src0", "src1"), 3).when(F.col("source").isin("src2", "src3"), 2).otherwise(1)
    points = sum((F.when(F.contains(c, F.lit(w)), n).otherwise(0) for w, n in (("the", 5), ("die", 4), ("les", 3), ("que", 2))), F.lit(0))
    rows = t.read(spark, sf_dir, "documents").select("doc_id", tier.alias("tier"), points.alias("points"))
    least = F.when(F.col("tier") == 3, 12).when(F.col("tier") == 2, 10).otherwise(5)
    return rows.select("doc_id", "tier", (F.col("points") * F.col("tier")).alias("score"), (F.col("points") * F.col("tier") >= least).alias("passed"))


@query("""WITH l AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(replace(p_type || ';' || p_brand || ' / ' || p_type, ' ', ''), '[;；,，、/|]'), lambda x: x <> '')) AS labels FROM part) SELECT p_partkey, len(labels) AS n, list_sort(labels)[1] AS first_label FROM l""")
def label_lists(spark, sf_dir):
    """labels split at several marks, each once."""
    joined = F.replace(F.concat("p_type", F.lit(";"), "p_brand", F.lit(" / "), "p_type"), F.lit(" "), F.lit(""))
    labels = F.array_distinct(F.filter(F.split(joined, "[;；,，、/|]"), lambda x: x != ""))
    return t.read(spark, sf_dir, "part").select("p_partkey", F.size(labels).cast("long").alias("n"), F.array_min(labels).alias("first_label"))


@query("""WITH r AS (SELECT user_id, date_trunc('month', min(ts))::DATE AS a, DATE '2029-06-15' AS b FROM events GROUP BY 1), c AS (SELECT user_id, b, unnest(generate_series(a, b, INTERVAL 24 MONTH))::DATE AS first FROM r)
SELECT user_id, first, least(b, (first + INTERVAL 24 MONTH - INTERVAL 1 DAY)::DATE) AS last FROM c""")
def range_chunks(spark, sf_dir):
    """a range cut into pieces of 24 months."""
    r = t.read(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.date_trunc("month", F.min("ts"))).alias("a"))
    end = F.lit("2029-06-15").cast("date")
    c = r.select("user_id", F.explode(F.sequence("a", end, F.expr("interval 24 months"))).alias("first"))
    return c.select("user_id", "first", F.least(end, F.date_sub(F.add_months("first", 24), 1)).alias("last"))


@query("""SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) < 570 THEN 'before' WHEN hour(ts) >= 16 THEN 'after' ELSE 'during' END AS session,
 CAST(CASE WHEN isodow(ts) = 1 THEN CAST(ts AS DATE) - 2 WHEN isodow(ts) = 7 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS DATE) AS window_start FROM events""")
def sessions_of_day(spark, sf_dir):
    """part of the trading day, and the first day that a run on this day covers."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    day = F.to_date("ts")
    start = F.when(F.weekday("ts") == 0, F.date_sub(day, 2)).when(F.weekday("ts") == 6, F.date_sub(day, 1)).otherwise(day)
    return t.read(spark, sf_dir, "events").select("event_id", F.when(minute < 570, "before").when(F.hour("ts") >= 16, "after").otherwise("during").alias("session"), start.alias("window_start"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL WHEN l_returnflag = 'R' THEN -abs(100 * (l_discount - l_tax)) ELSE 100 * (l_discount - l_tax) END AS pct FROM lineitem""")
def earnings_percent(spark, sf_dir):
    """negative kinds are made negative, nothing on nothing is missing."""
    pct = 100 * (F.col("l_discount") - F.col("l_tax"))
    out = F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(None)).when(F.col("l_returnflag") == "R", -F.abs(pct)).otherwise(pct)
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", out.alias("pct"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS rn FROM conversations) WHERE rn <= 50""")
def archive_tail(spark, sf_dir):
    """The last fifty entries of each archive."""
    rows = t.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ranking.top_n(rows, ["role"], [F.col("conv_id").desc(), F.col("turn").desc()], 50).drop("rank")


@query("""WITH s AS (SELECT DISTINCT p_brand, p_size, p_type FROM part) SELECT sha256(p_brand || '|' || p_size || '|' || p_type) AS identity, count(*) AS n FROM s GROUP BY 1""")
def identity_sets(spark, sf_dir):
    """Distinct parameter sets under the hash of their canonical form."""
    s = t.read(spark, sf_dir, "part").select("p_brand", "p_size", "p_type").distinct()
    return s.groupBy(F.sha2(F.concat_ws("|", "p_brand", F.col("p_size").cast("string"), "p_type"), 256).alias("identity")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT doc_id, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'ist'))::INT AS plus, (contains(lower(text), 'trash'))::INT + (contains(lower(text), 'worthless'))::INT + (contains(lower(text), 'disgusting'))::INT AS minus FROM documents)
SELECT doc_id, CASE WHEN plus > minus THEN 'positive' WHEN minus > plus THEN 'negative' ELSE 'neutral' END AS polarity FROM s""")
def text_polarity(spark, sf_dir):
    """which of two lists of words is met more."""
    c = F.lower("text")
    rows = t.read(spark, sf_dir, "documents").select("doc_id", text.count_terms(c, ["the", "ist"]).alias("plus"), text.count_terms(c, ["trash", "worthless", "disgusting"]).alias("minus"))
    return rows.select("doc_id", F.when(F.col("plus") > F.col("minus"), "positive").when(F.col("minus") > F.col("plus"), "negative").otherwise("neutral").alias("polarity"))


@query(f"""WITH {t.BARS}, f AS (SELECT code, date, close, 100.0::DOUBLE * (lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1) AS pct FROM bars), x AS (SELECT date, round(avg(pct), 6) AS mean_pct FROM f WHERE pct IS NOT NULL GROUP BY 1)
SELECT date, mean_pct, CASE WHEN mean_pct > 0.8 THEN 'up' WHEN mean_pct < -0.8 THEN 'down' ELSE 'flat' END AS context FROM x""")
def market_context(spark, sf_dir):
    """Label of a day by the mean of its sample."""
    w = windows.by(["code"])
    f = t.daily_bars(spark, sf_dir).select("date", (100.0 * (F.lead("close").over(w) / F.col("close") - 1)).alias("pct")).where("pct is not null")
    x = f.groupBy("date").agg(F.round(F.avg("pct"), 6).alias("mean_pct"))
    return x.withColumn("context", F.when(F.col("mean_pct") > 0.8, "up").when(F.col("mean_pct") < -0.8, "down").otherwise("flat"))


_slug = lambda c: f"coalesce(nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'none')"


@query(f"""WITH s AS (SELECT l_suppkey AS model, l_orderkey * 10 + l_linenumber AS seq, CAST(l_quantity AS BIGINT) % 5 AS value, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank, 'Agent ' || l_returnflag AS agent, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS harness, 'u' || l_orderkey AS url FROM lineitem),
d AS (SELECT model, value, rank, agent, harness, arg_max(url, seq) AS url FROM s GROUP BY ALL), k AS (SELECT *, {_slug('agent')} || ':' || {_slug('harness')} AS run FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rank, run, value DESC, url) AS place, count(*) OVER (PARTITION BY model) AS n FROM k)
SELECT model, n, n > 1 AS ambiguous, value, rank = 0 AS complete, run, url FROM o WHERE place = 1""")
def merged_disclosures(spark, sf_dir):
    """All that was disclosed of a model's score, once for each identity, the most complete first; ambiguous if there are several."""
    k = F.col("l_linenumber")
    rows = t.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 10 + k).alias("seq"), (F.col("l_quantity").cast("long") % 5).alias("value"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("complete"),
        F.struct(F.concat(F.lit("Agent "), F.col("l_returnflag")).alias("agent"), F.when(k > 3, F.col("l_linestatus")).alias("harness")).alias("run"), F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("url"),
    )
    out = disclosures.merged(rows, ["model"], "value", "complete", "run", "seq", ["url"])
    return out.select("model", "n", "ambiguous", "value", F.coalesce("complete", F.lit(False)).alias("complete"), F.col("run_key").alias("run"), "url")
