"""Rule-scored filings: best and worst by company, order, histograms, roll-ups, hit rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import merging, ranking
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: Scored rows: an order line is a filing of its supplier, scored by its terms.
_SCORED = """scored AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS code, l_returnflag AS kind, l_linestatus AS status, CAST(l_shipdate AS DATE) AS date,
  CAST(round(l_discount * 100) AS INTEGER) - CAST(round(l_tax * 100) AS INTEGER) + CASE WHEN l_returnflag = 'R' THEN -4 ELSE 1 END AS score, l_quantity AS scale FROM lineitem)"""


def scored(spark, sf_dir):
    lines = t.read(spark, sf_dir, "lineitem")
    score = F.round(F.col("l_discount") * 100).cast("int") - F.round(F.col("l_tax") * 100).cast("int") + F.when(F.col("l_returnflag") == "R", -4).otherwise(1)
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("code"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("date"), score.alias("score"), F.col("l_quantity").alias("scale"))


@query(f"""WITH {_SCORED}, g AS (SELECT code, id AS good_id, score AS good_score, scale AS good_scale FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score DESC, id) AS rn FROM scored WHERE score > 0) WHERE rn = 1),
b AS (SELECT code, id AS bad_id, score AS bad_score FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score, id) AS rn FROM scored WHERE score < 0) WHERE rn = 1)
SELECT code, good_id, good_score, good_scale, bad_id, bad_score FROM g FULL JOIN b USING (code)""")
def best_and_worst(spark, sf_dir):
    """Of each company the best good and the worst bad filing."""
    rows = scored(spark, sf_dir)
    good = merging.pick(rows.where("score > 0"), ["code"], [F.col("score").desc(), F.col("id")]).select("code", F.col("id").alias("good_id"), F.col("score").alias("good_score"), F.col("scale").alias("good_scale"))
    bad = merging.pick(rows.where("score < 0"), ["code"], [F.col("score"), F.col("id")]).select("code", F.col("id").alias("bad_id"), F.col("score").alias("bad_score"))
    return good.join(bad, "code", "full")


_BUCKET = "CASE WHEN score >= 7 THEN '7+' WHEN score >= 4 THEN '4..6' WHEN score >= 1 THEN '1..3' WHEN score > -3 THEN '-2..0' WHEN score > -6 THEN '-5..-3' ELSE '-6-' END"


@query(f"WITH {_SCORED} SELECT {_BUCKET} AS bucket, count(*) AS n, count(DISTINCT code) AS n_codes FROM scored GROUP BY 1")
def score_histogram(spark, sf_dir):
    """Filings by score range."""
    return scored(spark, sf_dir).groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("n_codes"))


@query(f"""WITH {_SCORED}, d AS (SELECT date, count(*) FILTER (WHERE score > 0) AS good, count(*) FILTER (WHERE score < 0) AS bad FROM scored GROUP BY 1)
SELECT *, CASE WHEN good > 1.5 * bad THEN 'good' WHEN bad > 1.5 * good THEN 'bad' ELSE 'balanced' END AS mood FROM d""")
def daily_mood(spark, sf_dir):
    """Label of a day by good and bad counts."""
    days = scored(spark, sf_dir).groupBy("date").agg(F.count_if(F.col("score") > 0).alias("good"), F.count_if(F.col("score") < 0).alias("bad"))
    return days.withColumn("mood", F.when(F.col("good") > 1.5 * F.col("bad"), "good").when(F.col("bad") > 1.5 * F.col("good"), "bad").otherwise("balanced"))


@query(f"WITH {_SCORED} SELECT kind, status, count(*) AS n, count(DISTINCT code) AS n_codes, min(score) AS worst FROM scored GROUP BY GROUPING SETS ((kind), (status), (kind, status), ())")
def risk_rollup(spark, sf_dir):
    """Counts by each level and overall in one pass."""
    levels = [["kind"], ["status"], ["kind", "status"], []]
    return scored(spark, sf_dir).groupingSets(levels, "kind", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("n_codes"), F.min("score").alias("worst"))


@query(f"""WITH {_SCORED}, {t.BARS}, nx AS (SELECT code, date, 100.0::DOUBLE * (lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1) AS pct FROM bars),
x AS (SELECT CASE WHEN score >= 4 THEN 'strong' WHEN score >= 1 THEN 'good' WHEN score >= 0 THEN 'flat' ELSE 'bad' END AS strength, score, pct FROM scored JOIN nx USING (code, date) WHERE pct IS NOT NULL)
SELECT strength, count(*) AS n, count(*) FILTER (WHERE CASE WHEN score > 0 THEN pct > 0 ELSE pct < 0 END) AS hits, round(100.0::DOUBLE * count(*) FILTER (WHERE CASE WHEN score > 0 THEN pct > 0 ELSE pct < 0 END) / count(*), 6) AS rate, round(avg(pct), 4) AS mean_pct FROM x GROUP BY 1""")
def hit_rate(spark, sf_dir):
    """How often the next session went the way a filing was judged, by strength."""
    bars = t.daily_bars(spark, sf_dir)
    w = Window.partitionBy("code").orderBy("date")
    nxt = bars.select("code", "date", (100.0 * (F.lead("close").over(w) / F.col("close") - 1)).alias("pct"))
    strength = F.when(F.col("score") >= 4, "strong").when(F.col("score") >= 1, "good").when(F.col("score") >= 0, "flat").otherwise("bad")
    rows = scored(spark, sf_dir).join(nxt, ["code", "date"]).where("pct is not null")
    hit = F.when(F.col("score") > 0, F.col("pct") > 0).otherwise(F.col("pct") < 0)
    out = rows.groupBy(strength.alias("strength")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg("pct"), 4).alias("mean_pct"))
    return out.select("strength", "n", "hits", F.round(F.col("hits") * 100.0 / F.col("n"), 6).alias("rate"), "mean_pct")


@query(f"""WITH {_SCORED} SELECT id, code, score, scale, row_number() OVER (ORDER BY score DESC, scale = 1, scale DESC, code, id) AS place FROM scored QUALIFY place <= 30""")
def filing_order(spark, sf_dir):
    """Best score first, rows without a scale last, then by scale; the first thirty."""
    order = [F.col("score").desc(), F.col("scale") == 1, F.col("scale").desc(), F.col("code"), F.col("id")]
    top = scored(spark, sf_dir).orderBy(*order).limit(30)
    return top.select("id", "code", "score", "scale", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query(f"""WITH {_SCORED}, f AS (SELECT code, date, kind, arg_max(score, abs(score)::BIGINT * 1000000000 - id) AS score, count(*) AS hits FROM scored GROUP BY 1, 2, 3) SELECT code, date, CAST(sum(score) AS BIGINT) AS score, CAST(sum(hits) AS BIGINT) AS hits FROM f GROUP BY 1, 2""")
def family_score(spark, sf_dir):
    """Of each family of signals the strongest counts once; a company's day is their sum."""
    key = F.abs("score").cast("long") * 1_000_000_000 - F.col("id")
    fam = scored(spark, sf_dir).groupBy("code", "date", "kind").agg(F.max_by("score", key).alias("score"), F.count(F.lit(1)).alias("hits"))
    return fam.groupBy("code", "date").agg(F.sum("score").alias("score"), F.sum("hits").alias("hits"))


@query(f"""WITH {_SCORED}, d AS (SELECT code, date, max(CASE WHEN score >= 7 THEN id END) AS good_id, min(CASE WHEN score <= -6 THEN id END) AS bad_id, min(score) AS worst FROM scored GROUP BY 1, 2)
SELECT code, date, CASE WHEN bad_id IS NULL THEN good_id END AS good_id, bad_id, worst BETWEEN -6 AND -1 AS mild FROM d""")
def suppressed_signals(spark, sf_dir):
    """A good signal is dropped where a bad one stands beside it; mild bad ones are set apart."""
    d = scored(spark, sf_dir).groupBy("code", "date").agg(F.max(F.when(F.col("score") >= 7, F.col("id"))).alias("good"), F.min(F.when(F.col("score") <= -6, F.col("id"))).alias("bad_id"), F.min("score").alias("worst"))
    return d.select("code", "date", F.when(F.col("bad_id").isNull(), F.col("good")).alias("good_id"), "bad_id", F.col("worst").between(-6, -1).alias("mild"))


@query(f"""WITH {_SCORED}, p AS (SELECT code, id, score, score > 0 AS up, row_number() OVER (PARTITION BY code, score > 0 ORDER BY abs(score) DESC, id) AS rn FROM scored WHERE score <> 0),
n AS (SELECT code, count(*) FILTER (WHERE up) AS np, count(*) FILTER (WHERE NOT up) AS nn FROM p GROUP BY 1), q AS (SELECT code, np, nn, least(2, nn) AS kn, CASE WHEN nn = 0 THEN 5 ELSE 3 + 2 - least(2, nn) END AS wp FROM n),
k AS (SELECT code, least(wp, np) + greatest(0, least(5 - least(wp, np) - kn, np - least(wp, np))) AS take_p, np, nn, kn FROM q)
SELECT p.code, id, score, CASE WHEN up THEN 'good' ELSE 'bad' END AS side FROM p JOIN k ON k.code = p.code WHERE CASE WHEN up THEN rn <= take_p ELSE rn <= least(nn, 5 - take_p) END""")
def balanced_rows(spark, sf_dir):
    """Three good and two bad rows of each company, what one side lacks filled from the other up to five."""
    rows = scored(spark, sf_dir).where("score <> 0").withColumn("up", F.col("score") > 0)
    return ranking.balanced(rows, "code", "up", [F.abs("score").desc(), F.col("id")], 3, 2, 5).select("code", "id", "score", F.when(F.col("up"), "good").otherwise("bad").alias("side"))


@query("""WITH c AS (SELECT l_suppkey AS code, unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')[1:3]) AS concept FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
g AS (SELECT concept, count(*) AS n, count(DISTINCT code) AS n_codes FROM c GROUP BY 1) SELECT * FROM g ORDER BY n DESC, concept LIMIT 10""")
def risk_concepts(spark, sf_dir):
    """The ten concepts met most among the first three of each risk, with the companies concerned."""
    lines = t.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey", F.col("l_suppkey").alias("code"))
    concepts = t.read(spark, sf_dir, "part").select("p_partkey", F.slice(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "), 1, 3).alias("concepts"))
    rows = lines.join(concepts, F.col("l_partkey") == F.col("p_partkey")).select("code", F.explode("concepts").alias("concept"))
    return rows.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("n_codes")).orderBy(F.col("n").desc(), "concept").limit(10)
