"""Comparisons of providers: variants A and B, the cube of providers and actions, frontiers of named sets, the state of result files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions.exprs import ratio
from framewell.operators.contracts import contract_errors, harmonised
from framewell.operators.tuning import MERGE, change_pct, local_frontier


def per_second(error: Column, seconds: Column, frames: Column) -> Column:
    """An error between neighbouring frames as one of a second: error / (seconds / (frames - 1)); one frame counts as two, null where the time is 0."""
    return ratio(error, seconds / F.greatest(F.lit(1), frames - 1))


def changes(rows: DataFrame, keys: Sequence[str], variant: str, base: str, current: str, metrics: dict[str, bool]) -> DataFrame:
    """keys, and for each metric base_<m>, current_<m> and change_<m> in percent of the base; null where the base is 0 or either is absent.

    metrics: name -> whether less is better, which makes a fall positive. A row for each key that has one of the two
    variants; of several rows of a variant the mean is taken. One aggregate, combined before the shuffle.
    """
    of = lambda m, which: F.avg(F.when(F.col(variant) == which, F.col(m)))
    sides = [of(m, which).alias(f"{side}_{m}") for m in metrics for side, which in (("base", base), ("current", current))]
    both = rows.where(F.col(variant).isin(base, current)).groupBy(*keys).agg(*sides)
    return both.withColumns({f"change_{m}": change_pct(F.col(f"current_{m}"), F.col(f"base_{m}"), less) for m, less in metrics.items()})


def comparison_cube(configs: DataFrame, recommended: DataFrame, known: DataFrame, manifest: DataFrame, evaluation: DataFrame, shapes: DataFrame, original: str, clones: Sequence[str]) -> DataFrame:
    """(place, provider, config, eligible, action, state, frame_count, runtimes ..., the columns of evaluation), a row for each card and action.

    configs (provider, config, eligible_for_final, passes_all_guardrails); recommended (provider, config); known
    (provider, place). A card is a provider's recommended configuration; a provider that is not known or whose
    recommendation is none of its configurations has none. The original's configuration stands under the names in clones
    as well, each with runs of its own. manifest (action, provider, evaluation_key, frame_count, v) gives the runs, their
    runtimes are read from v by shapes; evaluation (action, evaluation_key, metrics ...) their quality.
    state is ok, `no manifest entry` or `no evaluation`, and what is absent is null.
    """
    names = F.when(F.col("provider") == original, F.lit([original, *clones])).otherwise(F.array("provider"))
    eligible = F.coalesce(F.col("eligible_for_final") & F.col("passes_all_guardrails"), F.lit(False))
    cards = configs.join(recommended, ["provider", "config"], "left_semi").select(F.explode(names).alias("provider"), "config", eligible.alias("eligible"))
    cards = cards.join(known, "provider")
    runs = harmonised(manifest.join(known.select("provider"), "provider", "left_semi"), shapes).drop("v").withColumn("_run", F.lit(True))
    marked = evaluation.withColumn("_judged", F.lit(True))
    # cards and actions are the catalogue's rows, not the data's
    every = cards.crossJoin(manifest.select("action").distinct())
    out = every.join(runs, ["provider", "action"], "left").join(marked, ["action", "evaluation_key"], "left")
    state = F.when(F.col("_run").isNull(), "no manifest entry").when(F.col("_judged").isNull(), "no evaluation").otherwise("ok")
    measures = [c for c in [*runs.columns, *evaluation.columns] if c not in ("provider", "action", "evaluation_key", "_run")]
    return out.select("place", "provider", "config", "eligible", "action", state.alias("state"), *measures)


def frontiers(configs: DataFrame, key: str, metrics: Sequence[str], sets: dict[str, Column]) -> DataFrame:
    """(frontier, key): the frontier of each named set of rows, all in one pass over configs; see tuning.frontier."""
    member = F.explode(F.array_compact(F.array(*[F.when(of, F.lit(name)) for name, of in sets.items()]))).alias("frontier")
    rows = configs.select(member, key, *[F.col(m).cast("double").alias(m) for m in metrics]).dropna()
    locals_ = {name: local_frontier(key, metrics) for name in sets}

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for name, part in batch.groupby("frontier"):
                both = [kept[name], part] if name in kept else [part]
                kept[name] = next(iter(locals_[name](iter([pd.concat(both)]))))
        yield from kept.values()

    rows = rows.mapInPandas(prune, rows.schema)
    tasks = int(configs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // MERGE)
        rows = rows.repartition(tasks).mapInPandas(prune, rows.schema)
    return rows.select("frontier", key)


def file_states(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(path, n_configs, n_errors, first_error, status) for each result file of docs (path, v): status is 2 where the contract is broken, else 0."""
    n = F.coalesce(F.size(F.try_variant_get("v", "$.configs", "array<variant>")), F.lit(0))
    files = docs.select("path", F.when(F.col("v").isNull(), 0).otherwise(F.greatest(n, F.lit(0))).cast("long").alias("n_configs"))
    broken = contract_errors(docs, existing).groupBy("path").agg(F.count("*").alias("n_errors"), F.min("error").alias("first_error"))
    out = files.join(broken, "path", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("n_errors") > 0, 2).otherwise(0))
