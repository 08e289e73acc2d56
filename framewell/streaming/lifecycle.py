"""State of jobs over a stream, kept by transformWithState: timers tell jobs that stopped without an end."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewell.operators import telemetry as T

#: The state store that transformWithState needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "queued long, started long, finished long, end_id long, outcome string, error string, steps long, last long, last_id long, value double"
OUT = "user_id long, queued_at timestamp, started_at timestamp, finished_at timestamp, outcome string, error string, steps long, last_value double"


class Lifecycle(StatefulProcessor):
    """One job: a fixed number of fields, whatever the number of its events. Times are microseconds."""

    def __init__(self, queued: str, started: str, succeeded: str, failed: str, stall_ms: int) -> None:
        self.kinds, self.stall = (queued, started, succeeded, failed), stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        queued_kind, started_kind, succeeded, failed = self.kinds
        queued, started, finished, end_id, outcome, error, steps, last, last_id, value = self.job.get() if self.job.exists() else (None, None, None, None, "running", None, 0, None, None, None)
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.event_type == queued_kind:
                    queued = r.t if queued is None else min(queued, r.t)
                elif r.event_type == started_kind:
                    started = r.t if started is None else min(started, r.t)
                if r.event_type in (succeeded, failed):
                    if finished is None or (r.t, r.event_id) < (finished, end_id):
                        finished, end_id = r.t, r.event_id
                        outcome, error = ("succeeded", None) if r.event_type == succeeded else ("failed", r.text)
                    continue
                steps += 1
                if last is None or (r.t, r.event_id) > (last, last_id):
                    last, last_id, value = r.t, r.event_id, None if pd.isna(r.value) else float(r.value)
        if outcome == "stalled":
            outcome = "running"  # it went on
        self.job.update((queued, started, finished, end_id, outcome, error, steps, last, last_id, value))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if finished is None:
            self.handle.registerTimer(last // 1000 + self.stall)
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.job.exists() and self.job.get()[2] is None:
            state = list(self.job.get())
            state[4] = "stalled"
            self.job.update(tuple(state))
            yield self._row(key)

    def _row(self, key) -> pd.DataFrame:
        queued, started, finished, _, outcome, error, steps, _, _, value = self.job.get()
        times = {f"{n}_at": [pd.NaT if t is None else pd.Timestamp(t, unit="us")] for n, t in (("queued", queued), ("started", started), ("finished", finished))}
        return pd.DataFrame({"user_id": [key[0]], **times, "outcome": [outcome], "error": [error], "steps": [steps], "last_value": [value]})

    def close(self) -> None:
        pass


def job_state(events: DataFrame, delay: str = "1 day", stall_hours: float = 24.0, kinds: Sequence[str] = ("view", "click", "purchase", "error")) -> DataFrame:
    """A row for each change of a job (user_id): when it was queued, started and finished, how it ended first, its error, and what it had done: steps, and the last one's value.

    events: user_id, ts, event_id, event_type, value, props. kinds: what queues, starts, ends and fails a job. A job whose last
    step is older than the watermark by stall_hours without an end is stalled, until it goes on. Update mode; the
    session's state store must be STORE. The error is the failing event's props, redacted. Events older than
    the watermark (`delay` behind the newest) are dropped by Spark.
    """
    text = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(": "), F.coalesce(T.redacted(F.col("props")), F.lit("")))
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("t"), "event_id", "event_type", F.col("value").cast("double").alias("value"), text.alias("text"))
    return rows.groupBy("user_id").transformWithStateInPandas(Lifecycle(*kinds, int(stall_hours * 3_600_000)), OUT, "Update", "EventTime")


def job_state_twin(events: DataFrame, delay_hours: float = 24.0, stall_hours: float = 24.0, kinds: Sequence[str] = ("view", "click", "purchase", "error")) -> DataFrame:
    """What job_state() has said last of each job, when all events have come in order of time and the watermark has reached the newest."""
    queued, started, succeeded, failed = kinds
    kind, at = F.col("event_type"), F.struct("ts", "event_id")
    end, step = kind.isin(succeeded, failed), ~kind.isin(succeeded, failed)
    first_end = F.min_by(F.struct(kind.alias("kind"), "event_id", "props"), F.when(end, at))
    rows = events.groupBy("user_id").agg(
        F.min(F.when(kind == queued, F.col("ts"))).alias("queued_at"), F.min(F.when(kind == started, F.col("ts"))).alias("started_at"), F.min(F.when(end, F.col("ts"))).alias("finished_at"), first_end.alias("_end"),
        F.count_if(step).alias("steps"), F.max_by("value", F.when(step, at)).cast("double").alias("last_value"), F.max(F.when(step, F.col("ts"))).alias("_last"),
    )
    newest = events.agg((F.unix_micros(F.max("ts").cast("timestamp")) / 1000 - delay_hours * 3_600_000).alias("_mark"))  # one row
    stalled = F.col("_end").isNull() & (F.floor(F.unix_micros(F.col("_last").cast("timestamp")) / 1000) + stall_hours * 3_600_000 <= F.col("_mark"))
    outcome = F.when(F.col("_end.kind") == succeeded, "succeeded").when(F.col("_end.kind") == failed, "failed").when(stalled, "stalled").otherwise("running")
    text = F.when(F.col("_end.kind") == failed, F.concat(F.lit("event "), F.col("_end.event_id").cast("string"), F.lit(": "), F.coalesce(T.redacted(F.col("_end.props")), F.lit(""))))
    return rows.crossJoin(F.broadcast(newest)).select("user_id", "queued_at", "started_at", "finished_at", outcome.alias("outcome"), text.alias("error"), "steps", "last_value")
