"""Operators over run telemetry: upserts, filters, totals, latency, planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions.exprs import finite_or_null


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by `order`, all columns kept. Aggregates before the shuffle, so a hot key is one row a task."""
    value = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(value).select("_row.*")


def upsert(current: DataFrame, arrivals: DataFrame, owner: str, order: str = "ord") -> DataFrame:
    """Replaces a row of the same owner with the same clip, else the same file, else appends; later `order` wins."""
    rows = current.unionByName(arrivals, allowMissingColumns=True)
    key = F.coalesce(F.concat(F.lit("clip:"), F.nullif("clip", F.lit(""))), F.concat(F.lit("file:"), F.nullif("file", F.lit(""))), F.concat(F.lit("ord:"), F.col(order).cast("string")))
    return latest(rows.withColumn("_key", key), [owner, "_key"], [F.col(order)]).drop("_key")


def active_only(rows: DataFrame, active: Sequence[str], clip: str = "clip", source: str | None = "source_clip") -> DataFrame:
    """Drops rows whose clip, or else source clip, is named and not active; rows that name none stay."""
    named = F.nullif(F.col(clip), F.lit(""))
    if source:
        named = F.coalesce(named, F.nullif(F.col(source), F.lit("")))
    return rows.where(named.isNull() | named.isin(*active))


def step_totals(rows: DataFrame, run: str, step: str, seconds: str, tokens: str, local_steps: Sequence[str], token_steps: Sequence[str], image_steps: Sequence[str], video_steps: Sequence[str]) -> DataFrame:
    """Per run: seconds of remote and local steps, tokens, and counts of image and video tasks. Missing values add nothing."""
    s, x, t = F.col(step), F.coalesce(F.col(seconds), F.lit(0.0)), F.coalesce(F.col(tokens), F.lit(0))
    local = s.isin(*local_steps)
    return rows.groupBy(run).agg(
        F.sum(F.when(~local, x).otherwise(0.0)).alias("api_seconds"), F.sum(F.when(local, x).otherwise(0.0)).alias("local_seconds"), F.sum(x).alias("total_seconds"),
        F.sum(F.when(s.isin(*token_steps), t).otherwise(0)).cast("long").alias("tokens"),
        F.count_if(s.isin(*image_steps)).alias("image_tasks"), F.count_if(s.isin(*video_steps)).alias("video_tasks"),
    )


def usage_merge(rows: DataFrame, run: str, usage: str) -> DataFrame:
    """Numeric usage maps added key by key."""
    return rows.select(run, F.explode(usage).alias("name", "n")).groupBy(run, "name").agg(F.sum("n").alias("n"))


def latency(rows: DataFrame, key: str, value: str, order: Sequence[Column | str]) -> DataFrame:
    """Count, total, mean, mean without the first row (warm-up; a single row is its own), median, p95, max, and rows a second at the warm mean of milliseconds."""
    first = F.min_by(value, F.struct(*order))
    x, n = F.col(value), F.count(value)
    base = rows.groupBy(key).agg(n.alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("max"), first.alias("_first"))
    warm = F.when(F.col("n") > 1, (F.col("total") - F.col("_first")) / (F.col("n") - 1)).otherwise(F.col("mean"))
    return base.withColumn("warm_mean", warm).withColumn("steady_fps", F.try_divide(F.lit(1000.0), F.nullif("warm_mean", F.lit(0.0)))).drop("_first")


def warm_rows(rows: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """All rows but the first of each key, unless it is alone."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n"))
    return rows.join(first, key).where((F.col("_n") == 1) | (F.struct(*order) > F.col("_first"))).drop("_first", "_n")


def last_n(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def missing_work(targets: DataFrame, items: DataFrame, done: DataFrame, ready: DataFrame, target: str, item: str) -> DataFrame:
    """Per target that is ready: its items without a result, as a sorted list; items is a small stated list."""
    grid = targets.select(target).distinct().crossJoin(F.broadcast(items.select(item).distinct()))
    todo = grid.join(done.select(target, item).distinct(), [target, item], "left_anti").join(ready.select(target).distinct(), target, "left_semi")
    return todo.groupBy(target).agg(F.array_join(F.sort_array(F.collect_set(item)), ",").alias("missing"), F.count("*").alias("n_missing"))


def unmatched(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    return expected.join(produced.select(key).distinct(), key, "left_anti")


def set_difference_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys only a has, only b has, and both have."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    return x.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a") & F.col("_b")).alias("both"))


def first_acceptable(rows: DataFrame, key: str, order: Sequence[Column], accept: Column, value: str) -> DataFrame:
    """The first row of a key that is accepted, else its last, flagged for review."""
    at = F.struct(*order)
    hit = F.min_by(value, F.when(accept, at))
    out = rows.groupBy(key).agg(F.count_if(accept).alias("accepted"), F.count("*").alias("steps"), hit.alias("_hit"), F.max_by(value, at).alias("_last"))
    return out.select(key, "accepted", "steps", F.when(F.col("accepted") > 0, F.col("_hit")).otherwise(F.col("_last")).alias("chosen"), F.when(F.col("accepted") > 0, "ok").otherwise("review").alias("status"))


def attempts(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], success: Column, most: int) -> DataFrame:
    """Retry accounting of a key: attempts, attempts before the first success, exhausted, recovered."""
    at = F.struct(*order)
    marked = rows.withColumn("_ok", success).withColumn("_at", at)
    firsts = marked.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if("_ok").alias("successes"), F.min(F.when(F.col("_ok"), F.col("_at"))).alias("_first"))
    failed = marked.join(firsts, list(keys)).groupBy(*keys).agg(
        F.first("attempts").alias("attempts"), F.first("successes").alias("successes"),
        F.count_if(~F.col("_ok") & (F.col("_first").isNull() | (F.col("_at") < F.col("_first")))).alias("failed_first"),
    )
    return failed.withColumn("exhausted", (F.col("successes") == 0) & (F.col("attempts") >= most)).withColumn("recovered", (F.col("successes") > 0) & (F.col("failed_first") > 0))


def numeric_or_null(rows: DataFrame, column: str, factor: float = 1.0) -> DataFrame:
    return rows.withColumn(column, finite_or_null(F.col(column).cast("double")) * factor)


def redacted(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Literal secrets and the query part of addresses go."""
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("[redacted]"))
    return F.regexp_replace(text, r"(https?://[^\s?\"]+)\?[^\s\"]*", "$1")


def prioritised(rows: DataFrame, key: str, value: str, order: Sequence[Column | str]) -> DataFrame:
    """One value for each key: that of the least `order`."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def edge_profile(setting: Column, name: Column, markers: Sequence[str]) -> Column:
    """A setting other than `auto`, else cartoon where the name has one of the markers, else real."""
    return F.when(setting != "auto", setting).when(F.rlike(F.lower(name), F.lit("|".join(markers))), "cartoon").otherwise("real")

