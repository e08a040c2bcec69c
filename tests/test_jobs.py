"""Versions of tables, and job control as streams: restarts, repeated and late rows, lost writers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.sources import versions
from tickloom.streaming import incremental, jobs


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_touch_only_changed_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert versions.upsert(first, path, ["k"], buckets=16) == 1
    before = versions.manifest(spark, path)["folders"]
    assert versions.upsert(spark.createDataFrame([(5, "b"), (5000, "c")], "k long, v string"), path, ["k"]) == 2
    after = versions.manifest(spark, path)["folders"]
    assert len(before) == 16 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    want = {(k, "a") for k in range(1000)} - {(5, "a")} | {(5, "b"), (5000, "c")}
    assert set(rows_of(versions.read(spark, path))) == want and versions.read(spark, path).count() == 1001
    assert versions.read(spark, path, 1).where("k = 5").first()["v"] == "a"  # readers of the old version aren't disturbed
    assert versions.upsert(first.limit(0), path, ["k"]) == 3 and versions.read(spark, path).count() == 1001


def test_a_writer_whose_base_moved_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    versions.upsert(one, path, ["k"])
    versions.upsert(one.withColumn("v", F.lit("b")), path, ["k"], base=1)
    with pytest.raises(versions.Conflict):
        versions.upsert(one.withColumn("v", F.lit("c")), path, ["k"], base=1)
    # both started from version 2; the second to publish finds the number taken
    stale = versions.manifest(spark, path) | {"version": 3}
    versions._publish(spark, path, stale)
    with pytest.raises(versions.Conflict):
        versions._publish(spark, path, stale)
    assert rows_of(versions.read(spark, path)) == [(1, "b")]


def test_a_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    versions.upsert(one, path, ["k"])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(versions, "_publish", killed)
        versions.upsert(one.withColumn("v", F.lit("b")), path, ["k"])
    assert rows_of(versions.read(spark, path)) == [(1, "a")]
    assert versions.upsert(one.withColumn("v", F.lit("c")), path, ["k"]) == 2 and rows_of(versions.read(spark, path)) == [(1, "c")]
    assert versions.upsert(one.withColumn("v", F.lit("d")), path, ["k"]) == 3
    gone = versions.forget(spark, path, keep=1)
    assert len(gone) == 3 and rows_of(versions.read(spark, path)) == [(1, "d")]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    assert versions.upsert(one, path, ["k"], batch=("s", 0)) == 1
    assert versions.upsert(one.withColumn("v", F.lit("x")), path, ["k"], batch=("s", 0)) == 1
    assert rows_of(versions.read(spark, path)) == [(1, "a")]
    assert json.loads(json.dumps(versions.manifest(spark, path)))["batches"] == {"s": 0}


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, make, source, out, check, schema, rows):
    """Put rows into the source as one file and let the query take what is new, with its checkpoint."""
    if rows:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.read.parquet(out)


EVENTS = "scope string, job_id string, at timestamp, action string, error string"


def test_claims_over_restarts(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    step = lambda *rows: run(spark, jobs.claims, source, out, check, EVENTS, list(rows))
    step(("all", "a", at(0), "request", None), ("all", "b", at(1), "request", None), ("other", "z", at(1), "request", None), (None, "x", at(1), "request", None), ("all", "a", at(5), "running", None))
    got = step(("all", "c", at(30), "request", None), ("all", "b", at(31), "success", None), ("all", "a", at(40), "success", None), ("all", "a", at(41), "success", None))
    seen = {(r.scope, r.job_id, r.action, r.ms): (r.changed, r.owner, r.status) for r in got.collect()}
    ms = lambda m: int(at(m).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert seen["all", "a", "request", ms(0)] == (True, "a", "queued") and seen["all", "b", "request", ms(1)] == (False, "a", "queued")
    assert seen["all", "a", "running", ms(5)] == (True, "a", "running") and seen["all", "c", "request", ms(30)] == (False, "a", "running")
    assert seen["all", "b", "success", ms(31)] == (False, "a", "running")  # not the holder's
    assert seen["all", "a", "success", ms(40)] == (True, "a", "success") and seen["all", "a", "success", ms(41)] == (True, "a", "success")
    assert not any(s == "x" for _, s, *_ in seen)
    # fresh for six hours; afterwards a claim whose lock runs out is open to others
    step(("all", "d", at(100), "request", None), ("all", "e", at(40 + 361), "request", None))
    got = step(("all", "late", at(50), "request", None), ("all", "f", at(40 + 361 + 44), "request", None), ("all", "g", at(40 + 361 + 45), "running", None), ("other", "y", at(900), "request", None))
    got = step(("other", "y", at(901), "running", None), ("other", "y", at(902), "failed", "down"))
    seen = {(r.job_id, r.action): (r.changed, r.owner, r.status, r.error) for r in got.collect()}
    assert seen["d", "request"][:3] == (False, "a", "success") and seen["e", "request"][:3] == (True, "e", "queued")
    assert not any(job == "late" for job, _ in seen) and seen["f", "request"][:3] == (False, "e", "queued") and seen["g", "running"][:3] == (True, "g", "running")
    assert seen["g", "expired"][1:3] == ("g", "running") and seen["z", "expired"][1:3] == ("z", "queued")
    assert seen["y", "failed"] == (True, "y", "failed", "down")


RESULTS = "day date, shard int, code string, ok boolean, error string, at timestamp"


def test_progress_over_restarts(spark, tmp_path):
    out = {}

    def keep(batch, _):
        for r in batch.collect():
            out.setdefault((r.shard), []).append((r.processed, r.done, r.failed, r.pause_seconds, r.resumed))

    source, check, day = str(tmp_path / "in"), str(tmp_path / "check"), dt.date(2024, 1, 1)

    def step(*rows):
        spark.createDataFrame([(day, *r) for r in rows], RESULTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RESULTS).parquet(source)
        q = jobs.shard_progress(stream, pause_minutes=30, late="0 seconds").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(180)

    step((0, "a", True, None, at(0)), (0, "b", False, "x", at(1)), (1, "a", True, None, at(1)), (0, None, True, None, at(1)))
    assert out[0][-1] == (2, 1, 1, 1800, False) and out[1][-1] == (1, 1, 0, 0, False)
    step((0, "a", False, "again", at(5)), (0, "b", True, None, at(11)), (0, "c", False, "y", at(11)))
    assert out[0][-1] == (4, 2, 1, 1800, False)
    step((0, "a", True, None, at(0)), (1, "z", True, None, at(60)))  # repeated and late
    step((1, "z", True, None, at(61)))
    assert (4, 2, 1, 0, True) in out[0] and out[1][-1] == (2, 2, 0, 0, False)


def test_sink_takes_batches_once(spark, tmp_path):
    source, table, check, schema = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), "k long, n long"
    for n in range(3):
        spark.createDataFrame([(n, n), (100, n)], schema).coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_sink(spark.readStream.schema(schema).parquet(source), table, ["k"], [F.col("n").desc()], check, buckets=8).awaitTermination(120)
    assert rows_of(versions.read(spark, table)) == [(0, 0), (1, 1), (2, 2), (100, 2)] and versions.manifest(spark, table)["version"] == 3


def test_pause_left(spark):
    row = spark.createDataFrame([(at(0), at(29), None)], "a timestamp, b timestamp, c timestamp")
    assert tuple(row.select(jobs.pause_left(F.col("a"), F.col("b"), 30), jobs.pause_left(F.col("a"), F.col("b"), 5), jobs.pause_left(F.col("c"), F.col("b"), 5)).first()) == (60, 0, 0)
