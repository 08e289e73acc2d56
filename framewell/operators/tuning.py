"""Operators over benchmark configurations: normalising, rules, baselines, frontiers, ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions.exprs import finite_or_null, ratio
from framewell.operators.ranks import placed

#: Rows that the local pruning of a frontier holds at once.
PRUNE = 4096
#: Tasks whose frontiers one task merges.
MERGE = 16


def normalised(configs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Fixed fields: key `provider:id`, status (default unknown), notes (default empty), finite metrics or null, and a runtime: mean_inference_ms, else end_to_end_ms."""
    return configs.select(
        F.concat_ws(":", "provider", F.col("id").cast("string")).alias("key"), "provider", "id",
        F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("notes", F.lit("")).alias("notes"),
        *[finite_or_null(F.col(m)).alias(m) for m in metrics],
        F.coalesce(finite_or_null(F.col("mean_inference_ms")), finite_or_null(F.col("end_to_end_ms"))).alias("runtime_ms"),
    )


def rule_columns(rules: Sequence[tuple[str, str, str, str]]) -> Column:
    """The reasons of all rules that hold, as an array. A rule: reason, column, contains or equals, value; case does not count."""
    tests = []
    for reason, column, how, value in rules:
        text, value = F.lower(F.col(column)), value.lower()
        tests.append(F.when(F.contains(text, F.lit(value)) if how == "contains" else text == value, F.lit(reason)))
    return F.array_compact(F.array(*tests))


def eligibility(rows: DataFrame, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """rows plus exclusion_reasons, as text, and eligible."""
    reasons = rule_columns(rules)
    return rows.withColumn("exclusion_reasons", F.array_join(reasons, ",")).withColumn("eligible", F.size(reasons) == 0)


def row_errors(rows: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """A row for each check that a row fails: keys and the message. A check that is null fails."""
    messages = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks]))
    return rows.select(*keys, F.explode(messages).alias("error"))


def out_of_bounds(rows: DataFrame, keys: Sequence[str], values: str, bounds: DataFrame) -> DataFrame:
    """A row for each value of the map `values` that isn't between its bounds: bounds(parameter, lo, hi) is a table that users add rows to. Nulls are in no bounds."""
    each = rows.select(*keys, F.explode(values).alias("parameter", "value")).join(bounds, "parameter")
    return each.where(~F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False))).select(*keys, "parameter", "value")


def duplicates(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The second and later rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn > 1").drop("_rn")


def baseline_of(configs: DataFrame, candidate: Column, metrics: Sequence[str], legacy: DataFrame) -> DataFrame:
    """One row of metrics and its source: the candidate (the first by key) that has all of them, else the row of legacy."""
    complete = candidate
    for m in metrics:
        complete &= F.col(m).isNotNull()
    best = configs.where(complete).select(F.lit(0).alias("tier"), F.col("key").alias("source"), *metrics)
    rest = legacy.select(F.lit(1).alias("tier"), F.lit("legacy").alias("source"), *metrics)
    first = F.min_by(F.struct("source", *metrics), F.struct("tier", "source")).alias("_b")
    return best.unionByName(rest).agg(first).where("_b is not null").select("_b.*")


def against_baseline(configs: DataFrame, baseline: DataFrame, metrics: Sequence[str], limits: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Delta and ratio (null where the baseline is 0 or null) of each metric to a one-row baseline, and a guardrail for each limit (name, metric, factor, least): at most the baseline's value times the factor, or `least` if that is more; null fails."""
    base = baseline.select(*[F.col(m).alias(f"base_{m}") for m in metrics]).limit(1)  # one row
    out = configs.crossJoin(F.broadcast(base))
    for m in metrics:
        out = out.withColumn(f"delta_{m}", F.col(m) - F.col(f"base_{m}")).withColumn(f"ratio_{m}", ratio(F.col(m), F.col(f"base_{m}")))
    every = F.lit(True)
    for name, m, factor, least in limits:
        guard = F.coalesce(F.col(m) <= F.greatest(F.col(f"base_{m}") * factor, F.lit(least)), F.lit(False))
        out, every = out.withColumn(f"guard_{name}", guard), every & guard
    return out.withColumn("guardrail", every).drop(*[f"base_{m}" for m in metrics])


def local_frontier(key: str, metrics: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            for i in range(0, len(batch), PRUNE):
                part = batch.iloc[i : i + PRUNE]
                kept = part if kept is None else pd.concat([kept, part])
                x = kept[list(metrics)].to_numpy(np.float64)
                alive = np.ones(len(x), bool)
                for j in np.argsort(x.sum(1), kind="stable"):
                    if alive[j]:
                        alive &= ~((x[j] <= x).all(1) & (x[j] < x).any(1))
                kept = kept[alive]
        if kept is not None:
            yield kept

    return run


def frontier(configs: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Keys that no row dominates (all metrics at most, one less); rows with a null metric are out, equal rows keep each other.

    Tasks drop what their own rows dominate; what is left is dealt to fewer tasks, until one has seen all. It holds the
    frontier and a few rows more, whatever the number of configurations.
    """
    rows = configs.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).dropna()
    local, tasks = local_frontier(key, metrics), int(configs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.mapInPandas(local, rows.schema)
    while tasks > 1:
        tasks = -(-tasks // MERGE)
        rows = rows.repartition(tasks).mapInPandas(local, rows.schema)
    return rows.select(key)


def selection_scores(configs: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key and the weighted sum of normalised ranks over all rows, rank / (n - 1), ties in order of key; a row for each row of configs, also of those that repeat a key.

    All metrics are ranked in one order, metric after metric: each has n places.
    """
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.col(m).cast("double").alias("value")) for i, (m, w) in enumerate(weights.items())])
    # a row's number must be the same for all of its metrics: it is given before they part
    rows = configs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), each.alias("_each"))
    places = placed(rows.select("_row", "_key", F.explode("_each").alias("_m")).select("_row", "_key", "_m.*"), ["i", "value", "_key"], "place")
    n = places.where("i = 0").count()
    rank = F.col("place") - F.col("i") * n
    return places.groupBy("_row").agg(F.first("_key").alias(key), F.sum(F.col("w") * rank / max(1, n - 1)).alias("score")).drop("_row")


def group_scores(configs: DataFrame, group: str, key: str, weights: dict[str, float]) -> DataFrame:
    """selection_scores inside each group."""
    n = F.greatest(F.lit(1), F.count("*").over(Window.partitionBy(group)) - 1)
    score = F.lit(0.0)
    for m, w in weights.items():
        score += w * (F.row_number().over(Window.partitionBy(group).orderBy(m, key)) - 1) / n
    return configs.select(group, key, score.alias("score"))


def guarded_best(configs: DataFrame, key: str, stable: Column, viable: Column, order: Sequence[str], group: str | None = None) -> DataFrame:
    """The best of the stable and viable rows, else of the viable, else of all."""
    tier = F.when(stable & viable, 0).when(viable, 1).otherwise(2)
    best = F.min_by(F.struct(key, tier.alias("tier")), F.struct(tier, *order, key)).alias("_b")
    return (configs.groupBy(group) if group else configs.groupBy()).agg(best).select(*([group] if group else []), "_b.*")


def change_pct(current: Column, base: Column, lower_is_better: bool = True) -> Column:
    change = ratio(current - base, base) * 100
    return -change if lower_is_better else change
