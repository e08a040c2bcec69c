"""Feed queries: normalising, scoring, ordering and de-duplicating news-like rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import merging, moving, ranking
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: Now, for every score that depends on time.
NOW = "2024-01-31 00:00:00"
RULES = [("(?i)\\bstupid\\b|trash|worthless", "abuse"), ("###|&&&|%%%", "noise"), ("(?i)license|licensed", "licence"), ("@[a-z]+\\.|\\([0-9]{3}\\)", "contact"), (" \\| ", "table")]
_RULE_SQL = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{label}'" for p, label in RULES)


@query(f"SELECT doc_id, CASE {_RULE_SQL} ELSE 'other' END AS category FROM documents")
def text_category(spark, sf_dir):
    """Label of the first pattern that is found."""
    return t.read(spark, sf_dir, "documents").select("doc_id", text.first_rule(F.col("text"), RULES, "other").alias("category"))


@query("SELECT doc_id, label, score FROM documents JOIN (VALUES " + ", ".join(f"('{p}', '{label}', {i - 3})" for i, (p, label) in enumerate(RULES)) + ") AS r(pattern, label, score) ON regexp_matches(text, pattern)")
def rule_hits(spark, sf_dir):
    """Every rule of a table that a text meets. Rules are a fixed table, checked one by one in a projection."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(label).alias("label"), F.lit(i - 3).alias("score"))) for i, (p, label) in enumerate(RULES)]))
    return t.read(spark, sf_dir, "documents").select("doc_id", F.inline(hits))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, min(doc_id) AS first_id FROM documents GROUP BY 1, 2")
def feed_counts(spark, sf_dir):
    """Counts by channel and type."""
    return t.read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.xxhash64(F.lit(17), "text"), F.xxhash64(F.lit(4711), "text")).alias("n_texts"), F.min("doc_id").alias("first_id"))


@query("""WITH k AS (SELECT doc_id, source, length(text) AS score, left(lower(text), 30) AS head FROM documents)
SELECT doc_id, source, score, head FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY score DESC, doc_id) AS rn FROM k) WHERE rn = 1""")
def keep_best_title(spark, sf_dir):
    """Of rows with the same first 30 letters the one of highest score."""
    rows = t.read(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").cast("long").alias("score"), F.left(F.lower("text"), F.lit(30)).alias("head"))
    return merging.pick(rows, ["head"], [F.col("score").desc(), F.col("doc_id")])


@query("""WITH k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^www\\.', ''), '[?#].*$', ''), '/+$', '') AS link FROM pages)
SELECT page_id, link FROM (SELECT page_id, link, row_number() OVER (PARTITION BY link ORDER BY page_id) AS rn FROM k) WHERE rn = 1""")
def keep_first_link(spark, sf_dir):
    """The first row of each canonical link."""
    rows = t.read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("link"))
    return merging.pick(rows, ["link"], [F.col("page_id")])


@query("""WITH k AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, ts, value FROM events), g AS (
 SELECT user_id, event_type, day, count(*) AS n, max(ts) AS last_ts, max(value) AS best, min(event_id) AS first_id FROM k GROUP BY 1, 2, 3)
SELECT user_id, event_type, day, n, last_ts, round(best + least(24, 6 * (n - 1)), 6) AS score, first_id FROM g""")
def merge_by_event_key(spark, sf_dir):
    """Rows of one event key become one: best score, six more for each further source up to 24, latest time."""
    rows = t.read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    out = rows.groupBy("user_id", "event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.max("value").alias("best"), F.min("event_id").alias("first_id"))
    return out.select("user_id", "event_type", "day", "n", "last_ts", F.round(F.col("best") + F.least(F.lit(24), 6 * (F.col("n") - 1)), 6).alias("score"), "first_id")


@query("""SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def latest_then_best(spark, sf_dir):
    """Of each key the latest row, then the best."""
    rows = t.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return merging.pick(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("value").desc(), F.col("event_id")])


@query("""WITH top AS (SELECT event_id, ts, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 50),
pin AS (SELECT event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type = 'purchase' OR event_type = 'signup') WHERE rn = 1)
SELECT * FROM top UNION SELECT * FROM pin""")
def newest_with_pins(spark, sf_dir):
    """The newest rows, and the latest of each pinned kind even beyond the limit."""
    rows = t.read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    order = [F.col("ts").desc(), F.col("event_id")]
    pins = merging.pick(rows.where(F.col("event_type").isin("purchase", "signup")), ["event_type"], order)
    return rows.orderBy(*order).limit(50).unionByName(pins).distinct()


@query("""WITH q AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events),
p AS (SELECT *, row_number() OVER (ORDER BY turn, value DESC, event_id) AS place FROM q WHERE turn <= 40) SELECT event_id, event_type, value, turn, place FROM p WHERE place <= 40""")
def fair_selection(spark, sf_dir):
    """Heads of all queues before any second."""
    rows = t.read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ranking.round_robin(rows, "event_type", [F.col("value").desc(), F.col("event_id")], 40)


@query()
def priority_fair_selection(spark, sf_dir):
    """Two rows of each user's queue, best heads first, one of each link and title, a heavier source replacing a lighter one."""
    kind = F.col("event_type")
    weight = F.when(kind == "purchase", 1000).when(kind == "signup", 800).when(kind == "click", 700).when(kind == "view", 600).otherwise(500)
    rows = t.read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("queue"), "value", weight.alias("weight"), F.concat(F.lit("n.example/"), (F.col("event_id") % 900).cast("string")).alias("url"), F.concat(kind, F.lit(" "), (F.col("event_id") * 7 % 800).cast("string")).alias("title"))
    return ranking.priority_fair(rows, "queue", "value", "event_id", "weight", "url", "title", 2)


@query(f"""WITH e AS (SELECT event_id, value, greatest(0.5, date_sub('second', ts, TIMESTAMP '{NOW}') / 3600.0::DOUBLE) AS age FROM events)
SELECT event_id, round(value / pow(age, 0.65), 6) AS velocity, round(greatest(1 - 0.02 * age, 0.5), 6) AS decay, CASE WHEN age <= 2 THEN 10 WHEN age <= 6 THEN 8 WHEN age <= 12 THEN 5 WHEN age <= 24 THEN 3 ELSE 0 END AS recency,
 round(least(100, ln(1 + value) / ln(1 + 1000) * 90), 6) AS engagement FROM e""")
def engagement_scores(spark, sf_dir):
    """Velocity, decay, recency and size of a reaction at a stated now."""
    age = F.greatest(F.lit(0.5), F.timestamp_diff("SECOND", F.col("ts"), F.lit(NOW).cast("timestamp")) / 3600.0)
    rows = t.read(spark, sf_dir, "events").select("event_id", "value", age.alias("age"))
    recency = F.when(F.col("age") <= 2, 10).when(F.col("age") <= 6, 8).when(F.col("age") <= 12, 5).when(F.col("age") <= 24, 3).otherwise(0)
    return rows.select(
        "event_id",
        F.round(F.col("value") / F.pow("age", F.lit(0.65)), 6).alias("velocity"),
        F.round(F.greatest(1 - 0.02 * F.col("age"), F.lit(0.5)), 6).alias("decay"),
        recency.alias("recency"),
        F.round(F.least(F.lit(100.0), F.log1p("value") / F.log1p(F.lit(1000)) * 90), 6).alias("engagement"),
    )


_SAMPLE = "s.event_type <> 'error' AND CAST(s.ts AS DATE) BETWEEN CAST(e.ts AS DATE) - 29 AND CAST(e.ts AS DATE)"


@query(f"""WITH own AS (SELECT e.event_id, count(s.event_id) AS n, count(s.event_id) FILTER (WHERE s.value <= e.value) AS k FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND {_SAMPLE} GROUP BY 1),
every AS (SELECT e.event_id, count(s.event_id) AS n, count(s.event_id) FILTER (WHERE s.value <= e.value) AS k FROM (SELECT DISTINCT ON (value, CAST(ts AS DATE)) * FROM events) e LEFT JOIN events s ON {_SAMPLE} GROUP BY 1),
named AS (SELECT value, CAST(ts AS DATE) AS day, n, k FROM every JOIN events USING (event_id))
SELECT e.event_id, own.n, CAST(CASE WHEN own.n >= 5 THEN round(5 + 35.0::DOUBLE * own.k / own.n) WHEN g.n > 0 THEN round(5 + 35.0::DOUBLE * g.k / g.n) ELSE 18 END AS INTEGER) AS score
FROM events e JOIN own USING (event_id) JOIN named g ON g.value = e.value AND g.day = CAST(e.ts AS DATE)""")
def engagement_percentile(spark, sf_dir):
    """Rank among the samples of the last 30 days as each row sees them: the account's own if there are five, else all; 18 without any."""
    rows = t.read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account"), "value", F.to_date("ts").alias("day"), (F.col("event_type") != "error").alias("sample"))
    both = rows.select(F.explode(F.array("account", F.lit("*"))).alias("key"), "value", "day", "sample")
    ranks = moving.ranks_in_days(both, "key", "value", "day", "sample", 30)
    every = ranks.where("key = '*'").select("value", "day", F.col("n").alias("all_n"), F.col("at_most").alias("all_k"))
    out = rows.join(ranks.withColumnRenamed("key", "account"), ["account", "value", "day"]).join(every, ["value", "day"])
    share = lambda k, n: F.round(5 + 35.0 * F.col(k) / F.col(n)).cast("int")
    return out.select("event_id", "n", F.when(F.col("n") >= 5, share("at_most", "n")).when(F.col("all_n") > 0, share("all_k", "all_n")).otherwise(18).alias("score"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\x{4e00}-\\x{9fff}]+', ' ', 'g'), ' +', ' ', 'g')) AS normal,
 regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, sha256(text) AS sha FROM documents""")
def text_keys(spark, sf_dir):
    """normal form, slug and hash of the text."""
    rows = t.read(spark, sf_dir, "documents")
    return rows.select("doc_id", text.normalise(F.col("text")).alias("normal"), text.slug(F.col("text")).alias("slug"), F.sha2("text", 256).alias("sha"))


@query(f"""WITH s AS (SELECT doc_id, length(text) AS n, CASE WHEN contains(text, '###') THEN 1 ELSE 0 END + CASE WHEN contains(text, '&&&') THEN 1 ELSE 0 END + CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END AS bad,
 contains(text, 'License') OR contains(text, 'licensed') AS hard FROM documents), b AS (SELECT *, least(130, 80 + n // 500) AS score FROM s)
SELECT doc_id, bad, hard, CASE WHEN bad > 0 AND NOT hard THEN least(score, 72) ELSE score END AS score FROM b""")
def capped_score(spark, sf_dir):
    """a score by size with a ceiling, capped where noise meets no hard context."""
    c = F.col("text")
    rows = t.read(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n"), text.count_terms(c, ["###", "&&&", "!!"]).alias("bad"), (F.contains(c, F.lit("License")) | F.contains(c, F.lit("licensed"))).alias("hard"))
    score = F.least(F.lit(130), 80 + F.floor(F.col("n") / 500))
    return rows.select("doc_id", "bad", "hard", F.when((F.col("bad") > 0) & ~F.col("hard"), F.least(score, F.lit(72))).otherwise(score).alias("score"))


@query(f"""SELECT event_id, ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 3 DAY AND TIMESTAMP '{NOW}' + INTERVAL 1 HOUR AND event_type <> 'error'""")
def recent_rows(spark, sf_dir):
    """Rows of the last three days that aren't blocked."""
    now = F.lit(NOW).cast("timestamp")
    rows = t.read(spark, sf_dir, "events").where(F.col("ts").between(now - F.expr("interval 3 days"), now + F.expr("interval 1 hour")) & (F.col("event_type") != "error"))
    return rows.select("event_id", "ts", "event_type")


@query("""WITH x AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT k % 10 AS bucket, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM x GROUP BY 1""")
def nested_metrics(spark, sf_dir):
    """a value of the nested document, with a default for what lacks."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.read(spark, sf_dir, "events").select(k.alias("k")).groupBy((F.col("k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("""WITH d AS (SELECT conv_id, role, text, turn FROM conversations), g AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS n_roles, arg_min(text, turn) AS opening, arg_max(role, turn) AS last_role FROM d GROUP BY 1) SELECT * FROM g""")
def thread_summary(spark, sf_dir):
    """Rows of a thread with its first text and last speaker."""
    return t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("n_roles"), F.min_by("text", "turn").alias("opening"), F.max_by("role", "turn").alias("last_role"))
