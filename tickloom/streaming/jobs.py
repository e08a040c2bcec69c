"""Control of jobs as a stream: claims with locks that run out, progress by shard, pauses of a source.

State is kept by Spark's state store under the query's checkpoint, so a query that starts again goes on where it was.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A success is fresh for six hours, a lock holds for 45 minutes.
FRESH_MS = 6 * 3600 * 1000
LOCK_MS = 45 * 60 * 1000
BUSY = ("queued", "running")

CLAIMED = "scope string, job_id string, ms long, action string, changed boolean, owner string, status string, error string"
_STATE = "job string, status string, requested long, started long, finished long, success long, error string"


class _Claims(StatefulProcessor):
    """One scope: who holds it, since when, and when it last succeeded."""

    def __init__(self, fresh: int, lock: int):
        self.fresh, self.lock = fresh, lock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", _STATE)

    def _apply(self, s: dict, action: str, job: str, ms: int, error: str | None) -> bool:
        busy = s["status"] in BUSY
        held = s["started"] if s["started"] is not None else s["requested"]
        expired = held is None or held <= ms - self.lock
        if action == "request":
            if (s["success"] is not None and s["success"] >= ms - self.fresh) or (busy and not expired):
                return False
            s.update(job=job, status="queued", requested=ms, started=None, finished=None, error=None)
            return True
        mine = s["job"] == job and busy
        if action == "running":
            if not (mine or not busy or expired):
                return False
            same = s["job"] == job
            s.update(job=job, status="running", requested=s["requested"] if same and s["requested"] is not None else ms, started=s["started"] if same and s["started"] is not None else ms, finished=None, error=None)
            return True
        if not mine:
            return s["job"] == job and s["status"] == action  # said again
        s.update(status=action, started=s["started"] if s["started"] is not None else ms, finished=ms)
        if action == "success":
            s.update(success=ms, error=None)
        else:
            s["error"] = (error or "failed")[:1000]
        return True

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in _STATE.split(", ")]
        s = dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names)
        watermark = timerValues.getCurrentWatermarkInMs()
        for row in sorted(rows, key=lambda r: (r.ms, r.action != "success", r.action, r.job_id or "")):
            changed = self._apply(s, row.action, row.job_id, row.ms, row.error)
            yield Row(scope=key[0], job_id=row.job_id, ms=row.ms, action=row.action, changed=changed, owner=s["job"], status=s["status"], error=s["error"])
        self.state.update(tuple(s[n] for n in names))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s["status"] in BUSY:
            self.handle.registerTimer(max((s["started"] if s["started"] is not None else s["requested"]) + self.lock, watermark + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            job, status, *_, error = self.state.get()
            if status in BUSY:
                yield Row(scope=key[0], job_id=job, ms=expiredTimerInfo.getExpiryTimeInMs(), action="expired", changed=False, owner=job, status=status, error=error)


def claims(events: DataFrame, late: str = "10 minutes", fresh_ms: int = FRESH_MS, lock_ms: int = LOCK_MS) -> DataFrame:
    """What becomes of each event (scope, job_id, at, action, error) of a stream, as in a compare-and-set.

    A request claims its scope unless the last success is fresh or another job holds the lock; a job may say that it
    runs if it holds the scope, nobody does, or the lock has run out; success and failure count from the holder only,
    and saying them twice does no harm. Spark drops events that the watermark has passed, so they change nothing. A lock that runs out gives a row `expired`. Events of a scope in one batch are put in order of time in
    the task that holds the scope, so a trigger's size bounds it. Events without scope, time or action are left out.
    """
    events.sparkSession.conf.set(*STORE)
    named = events.where("scope IS NOT NULL AND at IS NOT NULL AND action IN ('request', 'running', 'success', 'failed')")
    rows = named.select("scope", "job_id", "action", "error", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return rows.groupBy("scope").transformWithState(_Claims(fresh_ms, lock_ms), CLAIMED, "append", "EventTime")


PROGRESS = "day date, shard int, processed long, done long, failed long, pause_seconds long, resumed boolean"


class _Progress(StatefulProcessor):
    """One shard of a day: codes that are done, codes that failed, and the last failure."""

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getMapState("done", "code string", "ms long")
        self.failed = handle.getMapState("failed", "code string", "ms long, error string")
        self.counts = handle.getValueState("counts", "processed long, done long, failed long, unhealthy long, latest long")

    def _row(self, key, counts, resumed: bool) -> Row:
        processed, done, failed, unhealthy, latest = counts
        left = max(0, math.ceil((self.pause - (latest - unhealthy)) / 1000)) if unhealthy is not None and not resumed else 0
        return Row(day=key[0], shard=key[1], processed=processed, done=done, failed=failed, pause_seconds=left, resumed=resumed)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        processed, done, failed, unhealthy, latest = self.counts.get() if self.counts.exists() else (0, 0, 0, None, None)
        for row in rows:
            latest = row.ms if latest is None else max(latest, row.ms)
            if self.done.containsKey((row.code,)):
                continue  # fetched before: whatever comes again changes nothing
            processed += 1
            if row.ok:
                self.done.updateValue((row.code,), (row.ms,))
                done += 1
                if self.failed.containsKey((row.code,)):
                    self.failed.removeKey((row.code,))
                    failed -= 1
            else:
                failed += not self.failed.containsKey((row.code,))
                self.failed.updateValue((row.code,), (row.ms, row.error))
                unhealthy = row.ms if unhealthy is None else max(unhealthy, row.ms)
        counts = (processed, done, failed, unhealthy, latest)
        self.counts.update(counts)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if unhealthy is not None and unhealthy + self.pause > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(unhealthy + self.pause)
        yield self._row(key, counts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.counts.exists():
            yield self._row(key, self.counts.get(), True)


def shard_progress(results: DataFrame, pause_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Progress of each (day, shard) after each batch of results (day, shard, code, ok, error, at).

    A code counts as done once; results that come again, within the watermark or after a restart, change nothing. `pause_seconds` is
    what is left, at the newest result, of the pause that the last failure calls for; a row with `resumed` comes when
    it is over. Codes are rows of a keyed state, so a shard may hold any number of them.
    """
    results.sparkSession.conf.set(*STORE)
    named = results.where("day IS NOT NULL AND shard IS NOT NULL AND code IS NOT NULL AND at IS NOT NULL")
    rows = named.select("day", F.col("shard").cast("int").alias("shard"), "code", F.coalesce("ok", F.lit(False)).alias("ok"), "error", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return rows.groupBy("day", "shard").transformWithState(_Progress(pause_minutes * 60_000), PROGRESS, "update", "EventTime")


def pause_left(unhealthy: Column, now: Column, minutes: int) -> Column:
    """Whole seconds that are left of a source's pause, 0 if it is over or there was no failure."""
    age = F.unix_micros(now) - F.unix_micros(unhealthy)
    return F.coalesce(F.greatest(F.lit(0), F.ceil((F.lit(minutes * 60_000_000) - age) / 1_000_000)), F.lit(0)).cast("long")
