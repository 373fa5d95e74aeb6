"""Streaming jobs and their batch twins: the same functions take a batch or a streaming frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from cuespark.operators import stats
from cuespark.sources.writers import upsert_cache


def provider_health(attempts: DataFrame, watermark: str | None = None) -> DataFrame:
    """(job, day, n, failed) by day of event time; with a watermark on ``ts`` for streams."""
    if watermark:
        attempts = attempts.withWatermark("ts", watermark)
        return (
            attempts.groupBy("job", F.window("ts", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))
            .select("job", F.floor(F.unix_millis("w.start") / 86_400_000).alias("day"), "n", "failed")
        )
    day = F.floor(F.col("ts_ms") / 86_400_000)
    return attempts.groupBy("job", day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failed"))


def activity_sessions(rows: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(media_id, start_ms, n): runs of rows with less than ``gap`` between them."""
    timed = rows.withColumn("__ts", F.timestamp_millis("start_ms"))
    if watermark:
        timed = timed.withWatermark("__ts", watermark)
    s = timed.groupBy("media_id", F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("media_id", F.unix_millis("w.start").alias("start_ms"), "n")


def cache_feed(clips: DataFrame, path: str, checkpoint: str, watermark: str = "1 hour"):
    """A running query that appends clips whose fingerprint is new within the watermark of ``ts``."""
    fresh = clips.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["fingerprint"])
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The ladder's step and the progress of each job are aggregations: their batch forms take streams
#: as they are, in update or complete mode.
retry_state_stream = stats.retry_state
progress_status_stream = stats.progress_status


class WorkerStates(StatefulProcessor):
    """One worker's attempts in order of their time, whatever order they come in.

    Attempts wait until the watermark has passed their time; a timer at that time then judges all
    that are due. A failed log-in sets a timer at the end of its cooling, which tells that the worker
    is alive again unless a later one has failed. A worker without an attempt for ``forget_ms`` is forgotten by a timer.
    """

    def __init__(self, cooling_ms: int, auth: Sequence[int], alarm: int, forget_ms: int) -> None:
        self.cooling_ms, self.auth, self.alarm, self.forget_ms = cooling_ms, tuple(auth), alarm, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_ms long, event_id long, status long, failed boolean")
        self.held = handle.getValueState("held", "last long, errors long, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples():
                self.waiting.appendValue((int(r.ts_ms), int(r.event_id), int(r.status), bool(r.failed)))
                self.handle.registerTimer(int(r.ts_ms))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        last, errors, seen = self.held.get() if self.held.exists() else (None, 0, None)
        rows = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, rest, out = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now], []
        for ts, event, status, failed in due:
            cooling = last is not None and ts - last < self.cooling_ms
            errors = errors + 1 if failed else max(0, errors - 1)
            if status in self.auth:
                last = ts
                self.handle.registerTimer(ts + self.cooling_ms)
            out.append((key[0], "attempt", ts, event, cooling, errors, failed and errors > 0 and errors % self.alarm == 0))
            seen = ts
        if last is not None and now == last + self.cooling_ms:
            out.append((key[0], "alive", now, None, False, errors, False))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.handle.registerTimer(seen + self.forget_ms)
        if seen is not None and now >= seen + self.forget_ms and not rest:
            self.held.clear()
        elif due:
            self.held.update((last, errors, seen))
        if out:
            yield pd.DataFrame(out, columns=["job", "kind", "at_ms", "event_id", "cooling", "errors", "alarm"]).astype({"event_id": "Int64"})


def worker_state_stream(attempts: DataFrame, cooling_ms: int = 1_800_000, auth: Sequence[int] = (401, 403), alarm: int = 20, watermark: str = "10 minutes", forget_ms: int = 7 * 86_400_000) -> DataFrame:
    """(job, kind, at_ms, event_id, cooling, errors, alarm) of attempts (job, ts_ms, event_id, status, failed), in append mode.

    ``attempt`` rows are those of ``stats.worker_state``, however attempts are spread over
    micro-batches, as long as none is later than ``watermark``; later ones are dropped and counted
    by Spark. ``alive`` rows tell when a worker's cooling has ended. A row comes once the watermark
    has passed its time. Spark's RocksDB state store has the timers and must be set for the session.
    A worker that is idle for ``forget_ms``, which should exceed the cooling, begins anew with no errors.
    """
    provider = attempts.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if not provider.endswith("RocksDBStateStoreProvider"):
        raise RuntimeError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider: only it keeps timers")
    kind = attempts.schema["job"].dataType.simpleString()
    wanted = attempts.select("job", "ts_ms", "event_id", F.coalesce("status", F.lit(0)).cast("long").alias("status"), F.coalesce("failed", F.lit(False)).alias("failed"), F.timestamp_millis("ts_ms").alias("__ts"))
    wanted = wanted.where("ts_ms is not null").withWatermark("__ts", watermark)
    return wanted.groupBy("job").transformWithStateInPandas(
        WorkerStates(cooling_ms, auth, alarm, forget_ms), f"job {kind}, kind string, at_ms long, event_id long, cooling boolean, errors long, alarm boolean", "Append", "EventTime"
    )


def cache_upserts(clips: DataFrame, path: str, checkpoint: str, key: str = "fingerprint", at: Sequence[str] = ("created_at",)):
    """A running query that puts the last row of each key of every micro-batch into its own folder below ``path``.

    A batch that is done again after a failure overwrites its folder, so nothing is counted twice;
    a batch writes only what it brings, however large the cache is. ``read_cache`` gives the cache.
    """

    def put(batch: DataFrame, number: int):
        upsert_cache(batch.limit(0), batch, key, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return clips.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cache(spark: SparkSession, path: str, key: str = "fingerprint", at: Sequence[str] = ("created_at",)) -> DataFrame:
    """The last written row of each key over all batches; write it to a new folder now and then to compact them."""
    written = spark.read.parquet(path).drop("batch")
    return upsert_cache(written.limit(0), written, key, at)
