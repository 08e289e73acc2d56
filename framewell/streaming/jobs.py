"""Job state over event streams (user_id, ts, event_id, event_type, value): each job has a batch twin among the queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.operators import telemetry as T

TERMINAL = ("purchase", "error")


def timed(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Event time as a timestamp with a watermark that bounds state."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def latest_status(events: DataFrame, terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """The latest status of each key; update or complete mode."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("status"), last.isin(*terminal).alias("terminal"))


def lifecycle(events: DataFrame, queued: str = "view", started: str = "click", terminal: Sequence[str] = TERMINAL) -> DataFrame:
    """When a job was queued, started and finished, and how it ended first."""
    kind, end = F.col("event_type"), F.col("event_type").isin(*terminal)
    return events.groupBy("user_id").agg(
        F.min(F.when(kind == queued, F.col("ts"))).alias("queued_at"), F.min(F.when(kind == started, F.col("ts"))).alias("started_at"), F.min(F.when(end, F.col("ts"))).alias("finished_at"),
        F.coalesce(F.min_by("event_type", F.when(end, F.struct("ts", "event_id"))), F.lit("running")).alias("outcome"),
    )


def bounded_log(events: DataFrame, n: int = 5) -> DataFrame:
    """The last n lines of each key so far, redacted, as one text: state is n lines a key."""
    lines = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", T.redacted(F.col("event_type")).alias("line"))

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in batches:
            rows += list(zip(pdf["t"].tolist(), pdf["event_id"].tolist(), pdf["line"].tolist(), strict=True))
            rows = sorted(rows)[-n:]
        state.update(tuple(list(c) for c in zip(*rows, strict=True)))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(rows)], "log": ["\n".join(f"{e} {line}" for _, e, line in rows)]})

    return lines.groupBy("user_id").applyInPandasWithState(keep, "user_id long, n int, log string", "t array<long>, e array<long>, line array<string>", "update", "NoTimeout")


def not_done(events: DataFrame, done: DataFrame, key: Sequence[str] = ("user_id", "event_type")) -> DataFrame:
    """First events of keys that have no result yet: a stream-static anti join and dropDuplicates."""
    return events.join(done.select(*key).distinct(), list(key), "left_anti").dropDuplicates(list(key))


def retries(events: DataFrame, most: int = 2) -> DataFrame:
    """Attempts, successes and exhaustion for each key and day."""
    ok = F.col("event_type") == "purchase"
    rows = events.where(F.col("event_type").isin(*TERMINAL)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = rows.groupBy("user_id", "day").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("successes"))
    return out.withColumn("exhausted", (F.col("successes") == 0) & (F.col("attempts") >= most))


def upsert_sink(path: str, owner: str = "user_id", parts: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the latest row of each (owner, event_type) in Parquet. A batch rewrites only the partitions it touches, so a repeated batch changes nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(owner, "event_type", "ts", "event_id", "value").withColumn("part", F.pmod(F.xxhash64(owner), F.lit(parts)).cast("int"))
        touched = [r.part for r in rows.select("part").distinct().collect()]  # at most `parts`
        if not touched:
            return
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            rows = rows.unionByName(spark.read.parquet(path).where(F.col("part").isin(touched)))
        new = T.latest(rows, [owner, "event_type"], ["ts", "event_id"])
        staged = f"{path}-staged/{epoch}"
        new.write.mode("overwrite").parquet(staged)  # the old partitions are read to the end before they go
        spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return write
