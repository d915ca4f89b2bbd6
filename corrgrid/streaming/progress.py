"""Job progress from stage events, as batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Weights of the stages of the stand-in events; each distinct stage counts once.
WEIGHTS = {"signup": 0.15, "view": 0.2, "click": 0.2, "purchase": 0.3, "error": 0.15}


def progress(events: DataFrame) -> DataFrame:
    """Per job the weight of its distinct stages, at most 0.99 until all are seen, then 1.

    A plain grouped aggregate with one flag per stage. On a stream its state is five flags, a count and a
    time per job and never leaves; job_events ends jobs and counts every event once.
    """
    seen = {s: F.max(F.when(F.col("event_type") == s, 1).otherwise(0)).alias(s) for s in WEIGHTS}
    g = events.groupBy("user_id").agg(*seen.values(), F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))
    total = sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0.0))
    done = sum((F.col(s) for s in WEIGHTS), F.lit(0)) == len(WEIGHTS)
    return g.select("user_id", "n_events", "last_ts", F.when(done, 1.0).otherwise(F.least(total, F.lit(0.99))).alias("progress"))


def status(events: DataFrame) -> DataFrame:
    """Latest event per job, ties to the greater event id."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_stage"), F.max("event_id").alias("cursor"))


def progress_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same on a stream; the watermark only bounds late events."""
    return progress(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay))


def feed(events: DataFrame, most: int = 10_000) -> DataFrame:
    """Every event with its place in its job, from 0; payloads longer than `most` are left out and marked."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    long = F.length("props") > most
    return events.select("user_id", "event_id", (F.row_number().over(w).cast("long") - 1).alias("cursor"), F.when(~long, F.col("props")).alias("props"), long.alias("elided"))


def shares(events: DataFrame) -> DataFrame:
    """Seconds of each stage of a job and their share of the job's."""
    g = events.groupBy("user_id", "event_type").agg(F.sum("value").alias("seconds"))
    total = F.nullif(F.sum("seconds").over(Window.partitionBy("user_id")), F.lit(0.0))
    return g.select("user_id", "event_type", "seconds", (F.col("seconds") / total).alias("share"))


def tail(events: DataFrame, path: str, checkpoint: str, every: str = "300 milliseconds", most: int = 10_000) -> StreamingQuery:
    """Append a stream of events to a folder as JSON lines, long payloads left out; restarts lose and repeat nothing."""
    long = F.length("props") > most
    out = events.select("user_id", "event_id", "ts", "event_type", F.when(~long, F.col("props")).alias("props"), long.alias("elided"))
    return out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


#: A job without events for so long ends as expired; a finished job is remembered for so long, so that replays change nothing.
IDLE = 3_600_000
JOB = "user_id long, kind string, progress double, n_events long, last_ts timestamp"


class JobProgress(StatefulProcessor):
    """Per job: the stages seen, the ids of its events and the time of the last one.

    An event counts once, by its id. Each batch that changes a job gives a row: progress, or final once
    all stages are seen. Then only a mark stays, which a timer removes when the watermark has passed
    every replay that could still be let in; a job that stays idle ends with a final row of its own.
    """

    def __init__(self, idle: int = IDLE) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "stages int, n_events long, last_ms long, done boolean")
        self.seen = handle.getMapState("seen", "event_id long", "at_ms long")

    def _row(self, user: int, kind: str, stages: int, n: int, last: int) -> Row:
        total = sum(w for i, w in enumerate(WEIGHTS.values()) if stages >> i & 1)
        share = 1.0 if stages == (1 << len(WEIGHTS)) - 1 else min(total, 0.99)
        return Row(user_id=user, kind=kind, progress=share, n_events=n, last_ts=datetime.fromtimestamp(last / 1000, timezone.utc).replace(tzinfo=None))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        stages, n, last, done = self.job.get() if self.job.exists() else (0, 0, 0, False)
        names, before = list(WEIGHTS), n
        for r in rows:
            if done or self.seen.containsKey((r.event_id,)):
                continue
            self.seen.updateValue((r.event_id,), (r.ms,))
            n, last = n + 1, max(last, r.ms)
            stages |= 1 << names.index(r.event_type) if r.event_type in WEIGHTS else 0
        if done or n == before:
            return
        done = stages == (1 << len(WEIGHTS)) - 1
        if done:
            self.seen.clear()
        self.job.update((stages, n, last, done))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield self._row(key[0], "final" if done else "progress", stages, n, last)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            stages, n, last, done = self.job.get()
            if not done:
                yield self._row(key[0], "expired", stages, n, last)
        self.job.clear()
        self.seen.clear()

    def close(self) -> None:
        pass


def job_events(events: DataFrame, delay: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """A stream of progress, final and expired rows of jobs (JOB) from a stream of events.

    Replayed events change nothing while their job is remembered, and later ones are behind the
    watermark; state leaves with the timer after a job's final row. Rows with a null job, id or time
    are left out. Needs a state store with timers, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.where("user_id is not null and event_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "event_type", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").transformWithState(JobProgress(idle), JOB, "update", "EventTime")
