"""Keyed stores: upserts, range replacement, claims, archives with a log, incremental reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import merging
from tickloom.plans.register import query
from tickloom.sources import tables as t


def _deliveries(spark, sf_dir):
    """An old and a new delivery of the same keyed rows: orders up to 1996, and those since then with corrected values. Both hold 1996."""
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"), t.cents("o_totalprice").alias("cents"), "o_orderpriority")
    corrected = F.col("cents") + F.when(F.col("o_orderpriority") == "1-URGENT", 100).otherwise(0)
    return rows.where("date < date'1997-01-01'").drop("o_orderpriority"), rows.where("date >= date'1996-01-01'").withColumn("cents", corrected).drop("o_orderpriority")


_DELIVERIES = """o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderpriority FROM orders),
old AS (SELECT id, date, status, cents FROM o WHERE date < DATE '1997-01-01'), new AS (SELECT id, date, status, cents + CASE WHEN o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END AS cents FROM o WHERE date >= DATE '1996-01-01')"""


@query(f"WITH {_DELIVERIES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def keyed_upsert(spark, sf_dir):
    """The new row replaces the old one of its key."""
    old, new = _deliveries(spark, sf_dir)
    return merging.last_wins(old, new, ["id"])


@query(f"WITH {_DELIVERIES} SELECT id, status, cents FROM new WHERE id NOT IN (SELECT id FROM old)")
def append_new(spark, sf_dir):
    """Rows whose key isn't there yet."""
    old, new = _deliveries(spark, sf_dir)
    return merging.append_unseen(old, new, ["id"], [F.col("cents").desc()]).select("id", "status", "cents")


@query(f"WITH {_DELIVERIES} SELECT * FROM old WHERE NOT (date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31') UNION ALL SELECT * FROM new WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def replace_year(spark, sf_dir):
    """U16, K3: what is stored for a range goes, what was fetched for it comes."""
    old, new = _deliveries(spark, sf_dir)
    year = F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return merging.replace_range(old, new.where(year), year)


@query(f"WITH {_DELIVERIES} SELECT old.id AS id, old.cents AS old_cents, new.cents AS new_cents, old.status AS old_status, new.status AS new_status, 'cents' AS changed FROM old JOIN new ON old.id = new.id WHERE old.cents <> new.cents")
def correction_log(spark, sf_dir):
    """What an upsert changed, field by field."""
    old, new = _deliveries(spark, sf_dir)
    return merging.correction_log(old, new, ["id"], ["cents", "status"]).select("id", "old_cents", "new_cents", "old_status", "new_status", "changed")


@query(f"WITH {_DELIVERIES} SELECT status AS kind, max(date) AS latest, arg_max(id, date::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS id, count(*) AS n FROM o GROUP BY 1")
def latest_by_kind(spark, sf_dir):
    """The newest row of each kind."""
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("kind"))
    return rows.groupBy("kind").agg(F.max("date").alias("latest"), F.max_by("id", F.struct("date", "id")).alias("id"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id AS job, max(ts) FILTER (WHERE event_type <> 'error') AS done, max(ts) FILTER (WHERE event_type = 'click') AS locked FROM events GROUP BY 1)
SELECT job, CASE WHEN done >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR THEN 'fresh' WHEN locked >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 45 MINUTE THEN 'locked' ELSE 'claimed' END AS outcome FROM s""")
def refresh_claims(spark, sf_dir):
    """Which jobs a compare-and-set would claim at a moment: neither fresh nor locked."""
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    s = t.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("done"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("locked"))
    outcome = F.when(F.col("done") >= now - F.expr("interval 6 hours"), "fresh").when(F.col("locked") >= now - F.expr("interval 45 minutes"), "locked").otherwise("claimed")
    return s.select("job", outcome.alias("outcome"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1), x AS (SELECT *, sum(CASE WHEN failed = 0 OR failed * 4 < n THEN 1 ELSE 0 END) OVER (ORDER BY day) AS ok_days FROM d)
SELECT day, n, failed, CAST(ok_days AS BIGINT) AS ok_days, failed * 4 >= n AS cooling FROM x""")
def backfill_progress(spark, sf_dir):
    """Days done so far, and days whose failures call for a pause."""
    from pyspark.sql import Window

    d = t.read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    good = F.when((F.col("failed") == 0) | (F.col("failed") * 4 < F.col("n")), 1).otherwise(0)
    run = F.sum(good).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # one row for each day
    return d.select("day", "n", "failed", run.alias("ok_days"), (F.col("failed") * 4 >= F.col("n")).alias("cooling"))


@query("""WITH e AS (SELECT *, date_sub('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM e)
SELECT user_id, CAST(visit AS BIGINT) AS visit, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def feed_visits(spark, sf_dir):
    """Runs of rows without a gap of over a day."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.read(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")))
    rows = rows.withColumn("visit", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 86400), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "visit").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
