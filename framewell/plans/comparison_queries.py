"""Comparisons of providers: suppliers are configurations, line numbers actions, return flags variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.operators import comparison as C
from framewell.operators import contracts as K
from framewell.operators import tuning as U
from framewell.plans.contract_queries import _CASES, _FIELDS, _NAMES, _json_of, _nested, result_files
from framewell.plans.registry import SQL, query, table
from framewell.plans.tuning_queries import _BASE, _COMPLETE, _DOMINATES, _ELIGIBLE, CFG, LIMITS, METRICS, RULES, baseline, configs

_AB = {"temporal": True, "per_second": True, "fragment": True, "runtime": True}


@query("a17_temporal_ab", """
with v as (select l_suppkey, l_returnflag, round(avg(l_tax), 6) as temporal, round(avg(case when l_linenumber > 2 then l_discount else 0 end), 6) as fragment, round(avg(l_extendedprice) / 1000, 6) as runtime,
    round(sum(l_quantity), 4) / 24 as seconds, count(*) as frames from lineitem where l_returnflag in ('A', 'R') group by all),
r as (select *, temporal / nullif(seconds / greatest(1, frames - 1), 0) as per_second from v),
a as (select * from r where l_returnflag = 'A'), b as (select * from r where l_returnflag = 'R')
select l_suppkey, round(a.per_second, 6) as base_per_second, round(b.per_second, 6) as current_per_second, """
    + ", ".join(f"round(-(b.{m} - a.{m}) / nullif(a.{m}, 0) * 100, 4) as change_{m}" for m in _AB) + " from a full join b using (l_suppkey)")
def _(spark, d):
    runs = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.avg("l_tax"), 6).alias("temporal"), F.round(F.avg(F.when(F.col("l_linenumber") > 2, F.col("l_discount")).otherwise(0.0)), 6).alias("fragment"), F.round(F.avg("l_extendedprice") / 1000, 6).alias("runtime"),
        (F.round(F.sum("l_quantity"), 4) / 24).alias("seconds"), F.count("*").alias("frames"),
    )
    runs = runs.withColumn("per_second", C.per_second(F.col("temporal"), F.col("seconds"), F.col("frames")))
    out = C.changes(runs, ["l_suppkey"], "l_returnflag", "A", "R", _AB)
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("base_per_second", "current_per_second")], *[F.round(f"change_{m}", 4).alias(f"change_{m}") for m in _AB])


ORIGINAL, CLONES = "adaptive_green_baseline", ["adaptive_green_edge_v2", "adaptive_green_temporal_v3"]
#: Providers of configurations: the known ones but the clones, one that is unknown and one whose recommendation is lost.
CANDIDATES = [*[n for n in _NAMES if n not in CLONES], "unknown_matting"]
LOST = "ben2"
_CANDIDATES = "[" + ", ".join(f"'{n}'" for n in CANDIDATES) + "]"
_RUNS = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query("j11_provider_cube", f"""{CFG},
pc as (select {_CANDIDATES}[id % {len(CANDIDATES)} + 1] as provider, id, mae, leak, status from cfg),
rec as (select provider, arg_min(id, (mae, id)) as id from pc group by provider),
known as (select unnest({_RUNS}) as provider, unnest(range({len(_NAMES)})) as place),
cards as (select unnest(case when provider = '{ORIGINAL}' then [provider, '{CLONES[0]}', '{CLONES[1]}'] else [provider] end) as provider, id::varchar as config, status = 'ok' and coalesce(leak <= 0.335::double, false) as eligible from pc join rec using (provider, id) where provider <> '{LOST}'),
m as (select 'line ' || l_linenumber as action, {_RUNS}[l_suppkey % {len(_NAMES)} + 1] as provider, 'e' || l_suppkey % {len(_NAMES)} as evaluation_key, count(*) as n, count(*) % 5 + 20 as frames from lineitem where not (l_linenumber = 2 and l_suppkey % {len(_NAMES)} = 7) group by all),
runs as (select action, provider, evaluation_key, frames::double as frame_count, {_CASES} from m),
ev as (select 'line ' || l_linenumber as action, 'e' || l_suppkey % {len(_NAMES)} as evaluation_key, round(avg(l_discount), 6) as mae, round(avg(l_tax), 6) as temporal_alpha_mae from lineitem where not (l_linenumber = 5 and l_suppkey % {len(_NAMES)} = 4) group by all)
select k.place::integer as place, c.provider, config, eligible, a.action, case when r.action is null then 'no manifest entry' when e.action is null then 'no evaluation' else 'ok' end as state, frame_count, {', '.join(K.RUNTIME_FIELDS)}, e.mae, temporal_alpha_mae
from cards c join known k on k.provider = c.provider cross join (select distinct action from m) a left join runs r on r.provider = c.provider and r.action = a.action left join ev e on e.action = r.action and e.evaluation_key = r.evaluation_key""")
def _(spark, d):
    cfg = configs(spark, d).select(F.element_at(F.lit(CANDIDATES), (F.col("id") % len(CANDIDATES) + 1).cast("int")).alias("provider"), "id", "mae", F.col("id").cast("string").alias("config"), (F.col("status") == "ok").alias("eligible_for_final"), (F.col("leak") <= 0.335).alias("passes_all_guardrails"))
    best = cfg.groupBy("provider").agg(F.min_by("config", F.struct("mae", "id")).alias("config"))
    recommended = best.withColumn("config", F.when(F.col("provider") == LOST, "removed").otherwise(F.col("config")))
    known = spark.createDataFrame([(n, i) for i, n in enumerate(_NAMES)], "provider string, place int")
    lines = table(spark, d, "lineitem").select("l_discount", "l_tax", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("action"), (F.col("l_suppkey") % len(_NAMES)).alias("i"))
    key = F.concat(F.lit("e"), F.col("i").cast("string")).alias("evaluation_key")
    runs = lines.where("not (action = 'line 2' and i = 7)").groupBy("action", "i").agg(F.count("*").alias("n"))
    manifest = runs.select("action", F.element_at(F.lit(_NAMES), (F.col("i") + 1).cast("int")).alias("provider"), key, (F.col("n") % 5 + 20).cast("double").alias("frame_count"), F.call_function("parse_json", _json_of(_nested(_FIELDS))).alias("v"))
    evaluation = lines.where("not (action = 'line 5' and i = 4)").groupBy("action", key).agg(F.round(F.avg("l_discount"), 6).alias("mae"), F.round(F.avg("l_tax"), 6).alias("temporal_alpha_mae"))
    out = C.comparison_cube(cfg, recommended, known, manifest, evaluation, K.runtime_shapes(spark), ORIGINAL, CLONES)
    return out.withColumns({f: F.round(f, 6) for f in K.RUNTIME_FIELDS})


_SETS = {"pareto_frontier": f"status = 'ok' and {_ELIGIBLE} and id % 3 <> 0 and gm and gl and gf", "parameter_pareto_frontier": f"status = 'ok' and {_ELIGIBLE}", "research_pareto_frontier": "status = 'ok'"}


@query("i10_frontiers", f"{_BASE} " + " union all ".join(f"select '{name}' as frontier, key from cmp a where {where} and {_COMPLETE} and not exists (select 1 from (select * from cmp where {where}) b where {_DOMINATES})" for name, where in _SETS.items()))
def _(spark, d):
    cfg = configs(spark, d)
    rows = U.eligibility(U.against_baseline(cfg, baseline(cfg), METRICS, LIMITS), RULES)
    ok, final = F.col("status") == "ok", F.col("eligible")
    sets = {"pareto_frontier": ok & final & F.col("guardrail") & (F.col("id") % 3 != 0), "parameter_pareto_frontier": ok & final, "research_pareto_frontier": ok}
    return C.frontiers(rows, "key", METRICS, sets)


# some files keep the contract
_KEPT = "n_nationkey % 6 = 3"
_GOOD = """'{"provider":"p' || n_nationkey || '","official_docs":[{"url":"https://d"}],"configs":[{"id":"a"},{"id":"b"},{"id":"c"}],"recommendation":{"config_id":"b"}}'"""
_ERRORS, _AFTER = SQL["p8_result_files"].split("\nselect path, 'not a JSON document'", 1)


@query("i10_validation", f"""{_ERRORS.replace("case when n_nationkey = 24 then null", f"case when n_nationkey = 24 then null when {_KEPT} then ({_GOOD})::json")}, e as (select path, 'not a JSON document'{_AFTER})
select f.path, coalesce(any_value(json_array_length(j, '$.configs')), 0)::bigint as n_configs, count(error) as n_errors, min(error) as first_error, case when count(error) > 0 then 2 else 0 end as status from files f left join e on e.path = f.path group by f.path""")
def _(spark, d):
    folders = spark.range(17).where("id not in (3, 8, 9)").select(F.concat(F.lit("out/"), F.col("id").cast("string")).alias("output_dir"))
    files = result_files(spark, d).join(table(spark, d, "nation").select(F.col("n_name").alias("path"), "n_nationkey"), "path")
    kept = F.when(F.expr(_KEPT), F.call_function("parse_json", F.expr(_GOOD))).otherwise(F.col("v"))
    return C.file_states(files.select("path", kept.alias("v")), folders)
