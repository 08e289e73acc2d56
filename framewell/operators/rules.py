"""Rules as rows: users add a row to a table, no code.

A rule is one or more rows (rule, flag, reason, column, test, value) with the same number. Conditions on one column are
alternatives, those on different columns must all hold. Tests: equals and contains, where case does not count, at_most
and at_least for numbers, missing. A table of rules is gathered to one row and broadcast behind a check of its size; the rows that
are judged are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule int, flag string, reason string, column string, test string, value string"
#: Conditions of a table of rules at most; a larger one is a mistake.
MOST = 10_000

# What keeps a configuration of the benchmark out of the final choice, by provider and id.
ELIGIBILITY = [
    (1, "fractional_alpha", "a binary mask is no fur matte", "provider", "contains", "sam2"),
    (2, "fractional_alpha", "binary post-processing removes soft fur", "id", "contains", "postprocess_binary"),
    (3, "commercial_use", "the licence is non-commercial", "provider", "equals", "official_matanyone_v1"),
    (4, "domain_fit", "trained on people, weaker on animals", "provider", "equals", "zhengpeng7/birefnet-matting"),
    (5, "domain_fit", "trained on people, fails at green edges", "provider", "equals", "paddle_matting"),
    (6, "visual_review", "a white rim was seen", "provider", "equals", "adaptive_green_baseline"),
    (6, "visual_review", "a white rim was seen", "id", "equals", "halo_none"),
    (6, "visual_review", "a white rim was seen", "id", "equals", "halo_cartoon"),
    (7, "visual_review", "more soft detail lost than won", "provider", "equals", "rembg"),
    (7, "visual_review", "more soft detail lost than won", "id", "contains", "alpha_fur_safe"),
]
FLAGS = ("fractional_alpha", "commercial_use", "visual_review", "domain_fit")


def rule_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE)


def _gathered(rules: DataFrame) -> DataFrame:
    """One row: the rules in order, each with its conditions."""
    n = rules.count()
    if n > MOST:
        raise ValueError(f"{n} conditions of rules are more than {MOST}")
    condition = F.struct("column", "test", F.lower("value").alias("value"))
    each = rules.groupBy("rule").agg(F.first("flag").alias("flag"), F.first("reason").alias("reason"), F.collect_set(condition).alias("conditions"), F.collect_set("column").alias("columns"))
    return each.agg(F.array_sort(F.collect_list(F.struct("rule", "flag", "reason", "conditions", "columns"))).alias("_rules"))


def _holds(values: Column, c: Column) -> Column:
    of = values[c["column"]]
    number, limit = of.try_cast("double"), c["value"].try_cast("double")
    test = c["test"]
    met = (
        F.when(test == "equals", of == c["value"]).when(test == "contains", F.contains(of, c["value"])).when(test == "at_most", number <= limit).when(test == "at_least", number >= limit)
        .when(test == "missing", of.isNull()).otherwise(F.raise_error(F.concat(F.lit("no test "), test)).cast("boolean"))
    )
    return F.coalesce(met, F.lit(False))


def held(rows: DataFrame, rules: DataFrame, columns: Sequence[str], name: str = "held") -> DataFrame:
    """rows plus `name`: the rules (rule, flag, reason) that hold for each, in order. columns: those that rules may ask for; a rule on another never holds, unless it is for missing values."""
    rows = rows.withColumn("_values", F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.lower(F.col(c).cast("string")) for c in columns])))
    both = rows.crossJoin(F.broadcast(_gathered(rules)))  # one row

    def whole(r: Column) -> Column:
        return F.forall(r["columns"], lambda k: F.exists(r["conditions"], lambda c: (c["column"] == k) & _holds(F.col("_values"), c)))

    found = F.transform(F.filter(F.coalesce("_rules", F.array()), whole), lambda r: F.struct(r["rule"].alias("rule"), r["flag"].alias("flag"), r["reason"].alias("reason")))
    return both.withColumn(name, found).drop("_values", "_rules")


def flagged(rows: DataFrame, rules: DataFrame, columns: Sequence[str], flags: Sequence[str] = FLAGS, every: str = "eligible_for_final") -> DataFrame:
    """rows plus a boolean for each flag, false where one of its rules holds, `every`, true where all rules are silent, and exclusion_reasons in order of the rules."""
    found = held(rows, rules, columns, "_held")
    broken = F.transform("_held", lambda r: r["flag"])
    return found.withColumns({f: ~F.array_contains(broken, f) for f in flags}).withColumn(every, F.size("_held") == 0).withColumn("exclusion_reasons", F.transform("_held", lambda r: r["reason"])).drop("_held")


def limited(rows: DataFrame, limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row (keys, name, holds) for each row and limit (name, metric, base, factor, least): the metric is at most base * factor, or `least` if that is more; null fails. rows: keys and a map `metrics`."""
    found = F.col("metrics")[F.col("metric")]
    holds = F.coalesce(found <= F.greatest(F.col("base") * F.col("factor"), F.col("least")), F.lit(False))
    if limits.count() > MOST:
        raise ValueError(f"more than {MOST} limits")
    return rows.crossJoin(F.broadcast(limits)).select(*keys, "name", holds.alias("holds"))
