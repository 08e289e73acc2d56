"""Tuning operators over suppliers of lineitem as configurations, and over parts as rule targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.operators import telemetry as T
from framewell.operators import tuning as U
from framewell.plans.registry import query, table

METRICS = ["mae", "fringe", "leak", "temporal", "runtime_ms"]
WEIGHTS = {"mae": 5.0, "fringe": 2.0, "leak": 2.0, "temporal": 3.0, "runtime_ms": 1.0}
#: reason, column, how, value
RULES = [("licence", "provider", "equals", "p3"), ("experimental", "provider", "contains", "7"), ("unknown status", "status", "equals", "unknown")]

CFG = """
with raw as (
  select l_suppkey as id, 'p' || (l_suppkey % 10)::varchar as provider, case when l_suppkey % 11 = 0 then null else 'ok' end as status,
    round(avg(l_discount), 6) as mae, round(avg(l_tax), 6) as fringe, round(avg(case when l_returnflag = 'R' then 1.0::double else 0.0::double end), 6) as leak,
    case when l_suppkey % 13 = 0 then null else round(avg(l_quantity) / 100, 6) end as temporal,
    case when l_suppkey % 7 = 0 then null else round(avg(l_extendedprice) / 1000, 6) end as mean_inference_ms, round(avg(l_extendedprice) / 500, 6) as end_to_end_ms
  from lineitem group by l_suppkey),
cfg as (select provider || ':' || id::varchar as key, provider, id, coalesce(status, 'unknown') as status, '' as notes, mae, fringe, leak, temporal,
  coalesce(mean_inference_ms, end_to_end_ms) as runtime_ms from raw)"""


def raw(spark, d):
    k = F.col("l_suppkey")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_discount"), 6).alias("mae"), F.round(F.avg("l_tax"), 6).alias("fringe"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("leak"),
        F.round(F.avg("l_quantity") / 100, 6).alias("temporal"), F.round(F.avg("l_extendedprice") / 1000, 6).alias("mean_inference_ms"), F.round(F.avg("l_extendedprice") / 500, 6).alias("end_to_end_ms"),
    ).select(
        k.alias("id"), F.concat(F.lit("p"), (k % 10).cast("string")).alias("provider"), F.when(k % 11 == 0, None).otherwise("ok").alias("status"), F.lit(None).cast("string").alias("notes"),
        "mae", "fringe", "leak", F.when(k % 13 == 0, None).otherwise(F.col("temporal")).alias("temporal"), F.when(k % 7 == 0, None).otherwise(F.col("mean_inference_ms")).alias("mean_inference_ms"), "end_to_end_ms",
    )


def configs(spark, d):
    return U.normalised(raw(spark, d), METRICS[:4])


@query("p4_normalise", f"{CFG} select * from cfg")
def _(spark, d):
    return configs(spark, d)


_ELIGIBLE = """(provider <> 'p3' and not contains(provider, '7') and status <> 'unknown')"""
_REASONS = """concat_ws(',', case when provider = 'p3' then 'licence' end, case when contains(provider, '7') then 'experimental' end, case when status = 'unknown' then 'unknown status' end)"""


@query("p6_eligibility", f"{CFG} select key, {_REASONS} as exclusion_reasons, {_ELIGIBLE} as eligible from cfg")
def _(spark, d):
    return U.eligibility(configs(spark, d), RULES).select("key", "exclusion_reasons", "eligible")


@query("p6_eligibility_parts", """
select p_partkey, concat_ws(',', case when lower(p_brand) = 'brand#13' then 'brand' end, case when contains(lower(p_type), 'brass') then 'material' end, case when contains(lower(p_type), 'small') then 'size' end) as exclusion_reasons,
  not (lower(p_brand) = 'brand#13' or contains(lower(p_type), 'brass') or contains(lower(p_type), 'small')) as eligible from part""")
def _(spark, d):
    rules = [("brand", "p_brand", "equals", "Brand#13"), ("material", "p_type", "contains", "BRASS"), ("size", "p_type", "contains", "SMALL")]
    return U.eligibility(table(spark, d, "part"), rules).select("p_partkey", "exclusion_reasons", "eligible")


@query("p8_contract_errors", """
select o_orderkey as id, error from (
  select o_orderkey, unnest(list_filter([case when not o_totalprice < 300000 then 'price out of range' end, case when not o_orderstatus in ('F', 'O') then 'unknown status' end,
    case when not starts_with(o_orderpriority, '1') and not starts_with(o_orderpriority, '2') then 'low priority' end], lambda x: x is not null)) as error from orders)
union all select distinct o_orderkey, 'no lines' from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select o_custkey, 'unknown customer' from orders where o_custkey not in (select c_custkey from customer)""")
def _(spark, d):
    orders = table(spark, d, "orders").select("*", F.col("o_orderkey").alias("id"))
    p = F.col("o_orderpriority")
    checks = [("price out of range", F.col("o_totalprice") < 300000), ("unknown status", F.col("o_orderstatus").isin("F", "O")), ("low priority", F.startswith(p, F.lit("1")) | F.startswith(p, F.lit("2")))]
    own = U.row_errors(orders, ["id"], checks)
    lines = T.unmatched(orders.select("id").distinct(), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "id").select("id", F.lit("no lines").alias("error"))
    unknown = T.unmatched(orders.select(F.col("o_custkey").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id").select("id", F.lit("unknown customer").alias("error"))
    return own.unionByName(lines).unionByName(unknown)


@query("w14_duplicate_ids", """
select l_orderkey, l_linenumber, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber) as rn from lineitem) where rn > 1""")
def _(spark, d):
    return U.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("p9_map_merge", """
select n_nationkey, coalesce(case when n_nationkey % 2 = 0 then 'even' end, n_name) as name, n_regionkey::varchar as region from nation""")
def _(spark, d):
    left = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    right = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("name"), F.lit("even"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    # the right side wins
    merged = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
    return table(spark, d, "nation").select("n_nationkey", merged["name"].alias("name"), merged["region"].alias("region"))


#: parameter, column, least, most
BOUNDS = [("size", "p_size", 5.0, 40.0), ("price", "p_retailprice", 910.0, 1500.0)]


@query("p17_bounds", "with b(parameter, lo, hi) as (values ('size', 5.0::double, 40.0::double), ('price', 910.0::double, 1500.0::double)), v as (select p_partkey, 'size' as parameter, p_size::double as value from part union all select p_partkey, 'price', p_retailprice::double from part) select p_partkey, parameter, value from v join b using (parameter) where value not between lo and hi")
def _(spark, d):
    bounds = spark.createDataFrame([(name, lo, hi) for name, _, lo, hi in BOUNDS], "parameter string, lo double, hi double")
    values = F.map_from_arrays(F.array(*[F.lit(name) for name, *_ in BOUNDS]), F.array(*[F.col(c).cast("double") for _, c, *_ in BOUNDS]))
    return U.out_of_bounds(table(spark, d, "part").select("p_partkey", values.alias("values")), ["p_partkey"], "values", bounds).select("p_partkey", "parameter", "value")


@query("p21_viable", f"{CFG} select key from cfg where mae <= 0.051 and leak <= 0.335 and status = 'ok'")
def _(spark, d):
    return configs(spark, d).where("mae <= 0.051 and leak <= 0.335 and status = 'ok'").select("key")


# the baseline: supplier 1's measures, scaled down so that the guardrails part the rows
_BASE = f"""{CFG}, base as (select mae * 0.69::double as mae, fringe * 0.69::double as fringe, leak * 0.28::double as leak, temporal, runtime_ms from cfg where id = 1),
cmp as (select c.*, c.mae - b.mae as dm, c.fringe - b.fringe as df, c.mae / nullif(b.mae, 0) as rm, c.fringe / nullif(b.fringe, 0) as rf,
  coalesce(c.mae <= greatest(b.mae * 1.5, 0), false) as gm, coalesce(c.leak <= greatest(b.leak * 4.0, 0.004::double), false) as gl, coalesce(c.fringe <= greatest(b.fringe * 1.5, 0), false) as gf from cfg c cross join base b)"""
#: name, metric, factor, least: of the foreground (here mae), the background (here leak) and the green edge
LIMITS = [("foreground_retention", "mae", 1.5, 0.0), ("background_control", "leak", 4.0, 0.004), ("green_edge", "fringe", 1.5, 0.0)]


def baseline(cfg):
    return cfg.where("id = 1").select((F.col("mae") * 0.69).alias("mae"), (F.col("fringe") * 0.69).alias("fringe"), (F.col("leak") * 0.28).alias("leak"), "temporal", "runtime_ms")


@query("j3_baseline_comparison", f"""{_BASE}
select key, round(dm, 6) as delta_mae, round(df, 6) as delta_fringe, round(rm, 6) as ratio_mae, round(rf, 6) as ratio_fringe, gm as guard_foreground_retention, gl as guard_background_control, gf as guard_green_edge, gm and gl and gf as guardrail from cmp""")
def _(spark, d):
    cfg = configs(spark, d)
    out = U.against_baseline(cfg, baseline(cfg), METRICS, LIMITS)
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("delta_mae", "delta_fringe", "ratio_mae", "ratio_fringe")], *[f"guard_{name}" for name, *_ in LIMITS], "guardrail")


@query("j3_tuned_baseline", f"""{CFG}, c as (select 'complete' as wanted, 5 as id union all select 'incomplete', 13 union all select 'absent', -1),
t as (select wanted, key as source, mae, fringe, leak, temporal from c join cfg using (id) where mae is not null and fringe is not null and leak is not null and temporal is not null),
l as (select mae, fringe, leak, temporal from cfg where id = 1)
select c.wanted, coalesce(t.source, 'legacy') as source, coalesce(t.mae, l.mae) as mae, coalesce(t.temporal, l.temporal) as temporal from c left join t using (wanted) cross join l""")
def _(spark, d):
    cfg = configs(spark, d)
    found = [U.baseline_of(cfg, F.col("id") == i, METRICS[:4], cfg.where("id = 1")).select(F.lit(w).alias("wanted"), "source", "mae", "temporal") for w, i in (("complete", 5), ("incomplete", 13), ("absent", -1))]
    return found[0].unionByName(found[1]).unionByName(found[2])


_DOMINATES = " and ".join(f"b.{m} <= a.{m}" for m in METRICS) + " and (" + " or ".join(f"b.{m} < a.{m}" for m in METRICS) + ")"
_COMPLETE = " and ".join(f"{m} is not null" for m in METRICS)


_OK = "ok as (select * from cfg where status = 'ok')"


@query("j4_pareto_all", f"{CFG}, {_OK} select key from ok a where {_COMPLETE} and not exists (select 1 from ok b where {_DOMINATES})")
def _(spark, d):
    return U.frontier(configs(spark, d).where("status = 'ok'"), "key", METRICS)


@query("j4_pareto_recommended", f"{CFG}, f as (select * from cfg where status = 'ok' and id % 5 = 0 and {_ELIGIBLE}) select key from f a where {_COMPLETE} and not exists (select 1 from f b where {_DOMINATES})")
def _(spark, d):
    recommended = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("id"))
    return U.frontier(U.eligibility(configs(spark, d), RULES).where("eligible and status = 'ok'").join(recommended, "id", "left_semi"), "key", METRICS)


@query("j4_pareto_final", f"{CFG}, f as (select * from cfg where status = 'ok' and {_ELIGIBLE}) select key from f a where {_COMPLETE} and not exists (select 1 from f b where {_DOMINATES})")
def _(spark, d):
    return U.frontier(U.eligibility(configs(spark, d), RULES).where("eligible and status = 'ok'"), "key", METRICS)


@query("j4_pareto_guarded", f"{_BASE}, f as (select * from cmp where status = 'ok' and gm and gl and gf and {_ELIGIBLE}) select key from f a where {_COMPLETE} and not exists (select 1 from f b where {_DOMINATES})")
def _(spark, d):
    cfg = configs(spark, d)
    guarded = U.against_baseline(cfg, baseline(cfg), METRICS, LIMITS).where("guardrail and status = 'ok'")
    return U.frontier(U.eligibility(guarded, RULES).where("eligible"), "key", METRICS)


@query("t8_sorted_frontier", f"{CFG}, {_OK} select string_agg(key, ',' order by key) as keys from ok a where {_COMPLETE} and not exists (select 1 from ok b where {_DOMINATES})")
def _(spark, d):
    return U.frontier(configs(spark, d).where("status = 'ok'"), "key", METRICS).agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))


_RANKS = " + ".join(f"{w} * (row_number() over (partition by provider order by {m}, key) - 1) / greatest(1, count(*) over (partition by provider) - 1)" for m, w in WEIGHTS.items())


@query("w7_rank_scores", f"{CFG}, ok as (select * from cfg where status = 'ok' and {_COMPLETE}) select provider, key, round({_RANKS}, 6) as score from ok")
def _(spark, d):
    rows = configs(spark, d).where(f"status = 'ok' and {_COMPLETE}")
    return U.group_scores(rows, "provider", "key", WEIGHTS).withColumn("score", F.round("score", 6))


_ALL_RANKS = " + ".join(f"{w} * (row_number() over (order by {m}, key) - 1) / greatest(1, count(*) over () - 1)" for m, w in WEIGHTS.items())


@query("w7_rank_scores_all", f"{CFG}, ok as (select * from cfg where status = 'ok' and {_COMPLETE}) select key, round({_ALL_RANKS}, 6) as score from ok")
def _(spark, d):
    rows = configs(spark, d).where(f"status = 'ok' and {_COMPLETE}")
    return U.selection_scores(rows, "key", WEIGHTS).withColumn("score", F.round("score", 6))


@query("t1_guarded_best", f"""{CFG}, t as (select *, case when coalesce(temporal, 9) < 0.26 and mae <= 0.051 then 0 when mae <= 0.051 then 1 else 2 end as tier from cfg)
select provider, arg_min(key, (tier, fringe, mae, key)) as key, min(tier) as tier from t group by provider""")
def _(spark, d):
    stable = F.coalesce("temporal", F.lit(9.0)) < 0.26
    return U.guarded_best(configs(spark, d), "key", stable, F.col("mae") <= 0.051, ["fringe", "mae"], "provider")


@query("t2_finalists", f"{CFG} select key, provider, mae from (select *, row_number() over (partition by provider order by mae, key) as rn from cfg where status = 'ok') where rn <= 2")
def _(spark, d):
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("provider").orderBy("mae", "key"))
    return configs(spark, d).where("status = 'ok'").withColumn("rn", rn).where("rn <= 2").select("key", "provider", "mae")


@query("a17_ab_change", """
with f as (select l_suppkey, round(avg(case when l_returnflag = 'A' then l_quantity end), 6) as a, round(avg(case when l_returnflag = 'R' then l_quantity end), 6) as b from lineitem group by l_suppkey)
select l_suppkey, a as base, b as current, round(-(b - a) / nullif(a, 0) * 100, 4) as change_pct from f""")
def _(spark, d):
    side = table(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg("l_quantity"))
    side = side.select("l_suppkey", F.round("A", 6).alias("base"), F.round("R", 6).alias("current"))
    return side.withColumn("change_pct", F.round(U.change_pct(F.col("current"), F.col("base")), 4))


@query("a18_roll_call", "select count(distinct p_brand) as brands, count(*) as parts, count(*) filter (p_size >= 10) as eligible, count(*) filter (p_size >= 10 and p_retailprice < 1200) as eligible_guarded from part")
def _(spark, d):
    return table(spark, d, "part").agg(F.count_distinct("p_brand").alias("brands"), F.count("*").alias("parts"), F.count_if(F.col("p_size") >= 10).alias("eligible"), F.count_if((F.col("p_size") >= 10) & (F.col("p_retailprice") < 1200)).alias("eligible_guarded"))


@query("j10_default_override", "select p_partkey, coalesce(case when p_partkey % 3 = 0 then p_size end, 25) as width, coalesce(case when p_partkey % 5 = 0 then p_type end, 'auto') as mode from part")
def _(spark, d):
    width, mode = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")), F.when(F.col("p_partkey") % 5 == 0, F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(width, F.lit(25)).alias("width"), F.coalesce(mode, F.lit("auto")).alias("mode"))


@query("j11_comparison_cube", """
with base as (select s_suppkey, s_name, n_name, r_name, count(*) as lines, round(sum(l_quantity), 4) as quantity from lineitem join supplier on s_suppkey = l_suppkey
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all)
select * from base union all select s_suppkey, s_name || ' (copy)', n_name, r_name, lines, quantity from base where s_suppkey = 1""")
def _(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")).join(sums, F.col("s_suppkey") == F.col("l_suppkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = s.join(n, "n_nationkey").join(table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey").select("s_suppkey", "s_name", "n_name", "r_name", "lines", "quantity")
    return out.unionByName(out.where("s_suppkey = 1").withColumn("s_name", F.concat("s_name", F.lit(" (copy)"))))


_PARETO = f"select key from cmp a where {_COMPLETE} and status = 'ok' and {_ELIGIBLE} and not exists (select 1 from (select * from cmp where status = 'ok' and {_ELIGIBLE}) b where {_DOMINATES})"


@query("i10_tuning_aggregate", f"""{_BASE}, front as ({_PARETO})
select cmp.key, {_ELIGIBLE} as eligible, gm and gl and gf as guardrail, round(dm, 6) as delta_mae, round(rm, 6) as ratio_mae, front.key is not null as on_frontier,
  case when status = 'unknown' or temporal is null then 'error' else 'ok' end as state from cmp left join front on front.key = cmp.key""")
def _(spark, d):
    cfg = configs(spark, d)
    rows = U.eligibility(U.against_baseline(cfg, baseline(cfg), METRICS, LIMITS), RULES)
    front = U.frontier(rows.where("eligible and status = 'ok'"), "key", METRICS).withColumn("on_frontier", F.lit(True))
    return rows.join(front, "key", "left").select(
        "key", "eligible", "guardrail", F.round("delta_mae", 6).alias("delta_mae"), F.round("ratio_mae", 6).alias("ratio_mae"), F.coalesce("on_frontier", F.lit(False)).alias("on_frontier"),
        F.when((F.col("status") == "unknown") | F.col("temporal").isNull(), "error").otherwise("ok").alias("state"),
    )


@query("i10_header", f"""{_BASE} select count(distinct provider) as providers, count(*) as configs, count(*) filter ({_ELIGIBLE}) as eligible, count(*) filter ({_ELIGIBLE} and gm and gl and gf) as eligible_guarded,
  count(*) filter (status = 'unknown' or temporal is null) as errors from cmp""")
def _(spark, d):
    cfg = configs(spark, d)
    rows = U.eligibility(U.against_baseline(cfg, baseline(cfg), METRICS, LIMITS), RULES)
    return rows.agg(F.count_distinct("provider").alias("providers"), F.count("*").alias("configs"), F.count_if("eligible").alias("eligible"), F.count_if(F.expr("eligible and guardrail")).alias("eligible_guarded"), F.count_if(F.expr("status = 'unknown' or temporal is null")).alias("errors"))
