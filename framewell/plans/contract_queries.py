"""Rules as rows, contract checks and runtimes of differing shapes, over documents that the driver tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.operators import contracts as K
from framewell.operators import rules as R
from framewell.operators import tuning as U
from framewell.plans.registry import query, table
from framewell.plans.tuning_queries import _BASE, LIMITS, METRICS, baseline, configs

PROVIDERS = ["official_SAM2", "tool", "official_matanyone_v1", "ZhengPeng7/BiRefNet-matting", "paddle_matting", "adaptive_green_baseline", "rembg", "ben2"]
IDS = ["halo_none", "Halo_Cartoon", "POSTPROCESS_BINARY_3", "alpha_fur_safe_2", "plain"]
_LIST = "[" + ", ".join(f"'{p}'" for p in PROVIDERS) + "]"
_IDS = "[" + ", ".join(f"'{p}'" for p in IDS) + "]"


@query("p6_rules_as_rows", f"""
with c as (select p_partkey, lower({_LIST}[p_partkey % 8 + 1]) as provider, lower({_IDS}[p_partkey // 8 % 5 + 1]) as id, p_size from part),
h as (select *, contains(provider, 'sam2') as r1, contains(id, 'postprocess_binary') as r2, provider = 'official_matanyone_v1' as r3, provider = 'zhengpeng7/birefnet-matting' as r4, provider = 'paddle_matting' as r5,
  provider = 'adaptive_green_baseline' and id in ('halo_none', 'halo_cartoon') as r6, provider = 'rembg' and contains(id, 'alpha_fur_safe') as r7, p_size >= 48 as r8 from c)
select p_partkey, not (r1 or r2) as fractional_alpha, not r3 as commercial_use, not (r6 or r7) as visual_review, not (r4 or r5 or r8) as domain_fit, not (r1 or r2 or r3 or r4 or r5 or r6 or r7 or r8) as eligible_for_final,
  concat_ws('; ', case when r1 then 'a binary mask is no fur matte' end, case when r2 then 'binary post-processing removes soft fur' end, case when r3 then 'the licence is non-commercial' end, case when r4 then 'trained on people, weaker on animals' end,
    case when r5 then 'trained on people, fails at green edges' end, case when r6 then 'a white rim was seen' end, case when r7 then 'more soft detail lost than won' end, case when r8 then 'too large' end) as exclusion_reasons from h""")
def _(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.lit(PROVIDERS), (k % 8 + 1).cast("int")).alias("provider"), F.element_at(F.lit(IDS), (F.floor(k / 8) % 5 + 1).cast("int")).alias("id"), "p_size")
    # a user's own row beside the fixed ones
    rules = R.rule_table(spark, [*R.ELIGIBILITY, (8, "domain_fit", "too large", "p_size", "at_least", "48")])
    out = R.flagged(rows, rules, ["provider", "id", "p_size"])
    return out.select("p_partkey", *R.FLAGS, "eligible_for_final", F.array_join("exclusion_reasons", "; ").alias("exclusion_reasons"))


@query("u3_limits_as_rows", f"{_BASE} select key, 'foreground_retention' as name, gm as holds from cmp union all select key, 'background_control', gl from cmp union all select key, 'green_edge', gf from cmp")
def _(spark, d):
    cfg = configs(spark, d)
    base = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("metric"), F.col(m).alias("base"), F.lit(f).alias("factor"), F.lit(least).alias("least")) for n, m, f, least in LIMITS]))
    limits = baseline(cfg).select(base.alias("l")).select("l.*")
    rows = cfg.select("key", F.map_from_arrays(F.lit(METRICS), F.array(*METRICS)).alias("metrics"))
    return R.limited(rows, limits, ["key"])


# a result file for each nation, its suppliers the configurations, with faults by key
_ITEM = """case when s_suppkey % 11 = 0 then '"oops"' when s_suppkey % 7 = 0 then '{"id":""}' else '{"id":"' || case when s_suppkey % 3 = 0 then 'c' || s_suppkey else 'd' || s_suppkey % 2 end || '","status":"' || case when s_suppkey % 2 = 1 then 'ok' else 'failed' end || '","output_dir":"out/' || s_suppkey % 17
  || '","quality":{"pseudo_mae":' || case s_suppkey % 6 when 0 then '"bad"' when 1 then 'null' else '0.0' || s_suppkey end || '},"runtime":{"mean_inference_ms":' || case when s_suppkey % 5 = 0 then 'true' else '1.5' end || '},"temporal_alpha_mae":' || case when s_suppkey % 9 = 0 then '[1]' else '0.1' end || '}' end"""
_HEAD = """case n_nationkey % 5 when 0 then '" "' when 1 then '{"name":"p' || n_nationkey || '"}' when 2 then '7' else '"p' || n_nationkey || '"' end || ',"official_docs":' || case n_nationkey % 4 when 0 then '[]' when 1 then '[{"url":"http://a"},{"url":"ftp://b"},"x"]' else '[{"url":"https://d/' || n_nationkey || '"}]' end"""
_TAIL = """case n_nationkey % 3 when 0 then '{"config_id":"zzz"}' when 1 then '{"config_id":"","selected_config_id":"d1"}' else '{}' end"""


def result_files(spark, d):
    """(path, v)."""
    items = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", F.expr(_ITEM).alias("item"))
    joined = items.groupBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "item"))), lambda x: x["item"]), ",").alias("items"))
    files = table(spark, d, "nation").join(joined, "n_nationkey", "left")
    text = F.concat(F.lit('{"provider":'), F.expr(_HEAD), F.lit(',"configs":['), F.coalesce("items", F.lit("")), F.lit('],"recommendation":'), F.expr(_TAIL), F.lit("}"))
    broken = F.when(F.col("n_nationkey") == 24, F.substring(text, 2, 9)).otherwise(text)
    return files.select(F.col("n_name").alias("path"), F.call_function("try_parse_json", broken).alias("v"))


_FILES = f"""items as (select s_nationkey as n_nationkey, string_agg({_ITEM}, ',' order by s_suppkey) as items from supplier group by s_nationkey),
files as (select n_name as path, case when n_nationkey = 24 then null else ('{{"provider":' || {_HEAD} || ',"configs":[' || coalesce(items, '') || '],"recommendation":' || {_TAIL} || '}}')::json end as j from nation left join items using (n_nationkey)),
c as (select path, i, json_extract(j, '$.configs[' || i || ']') as c from (select path, j, unnest(range(json_array_length(j, '$.configs')::bigint)) as i from files)),
ci as (select *, case when json_type(c) = 'OBJECT' and json_type(c, '$.id') = 'VARCHAR' then nullif(json_extract_string(c, '$.id'), '') end as id from c),
od as (select path, i, json_extract(j, '$.official_docs[' || i || ']') as o from (select path, j, unnest(range(json_array_length(j, '$.official_docs')::bigint)) as i from files)),
rec as (select path, coalesce({', '.join(f"nullif(json_extract_string(j, '$.recommendation.{k}'), '')" for k in K.RECOMMENDATION)}) as id from files),
fields(name, p) as (values {', '.join([*(f"('quality.{f}', '$.quality.{f}')" for f in K.QUALITY), *(f"('runtime.{f}', '$.runtime.{f}')" for f in K.RUNTIME), "('temporal_alpha_mae', '$.temporal_alpha_mae')"])})"""


@query("p8_result_files", f"""with {_FILES}
select path, 'not a JSON document' as error from files where j is null
union all select path, 'provider must be a non-empty string' from files where j is not null and coalesce(case when json_type(j, '$.provider.name') = 'VARCHAR' then trim(json_extract_string(j, '$.provider.name')) end, case when json_type(j, '$.provider') = 'VARCHAR' then trim(json_extract_string(j, '$.provider')) end, '') = ''
union all select path, 'official_docs must contain at least one item' from files where json_array_length(j, '$.official_docs') = 0
union all select path, 'official_docs[' || i || '] must contain an HTTP(S) url' from od where not coalesce(starts_with(case when json_type(o, '$.url') = 'VARCHAR' then json_extract_string(o, '$.url') end, 'http'), false)
union all select path, 'configs must contain at least one configuration' from files where json_array_length(j, '$.configs') = 0
union all select path, 'expected at least 3 configurations, got ' || json_array_length(j, '$.configs') from files where json_array_length(j, '$.configs') < 3
union all select path, 'configs[' || i || '] must be an object' from ci where json_type(c) <> 'OBJECT'
union all select path, 'configs[' || i || '].id must be a non-empty string' from ci where json_type(c) = 'OBJECT' and id is null
union all select path, 'duplicate config id: ' || id from (select *, row_number() over (partition by path, id order by i) as k from ci where id is not null) where k > 1
union all select path, 'configs[' || i || '].' || name || ' must be finite number or null' from ci cross join fields where id is not null and coalesce(json_type(c, p), 'NULL') not in ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE')
union all select path, 'configs[' || i || '].output_dir does not exist: ' || json_extract_string(c, '$.output_dir') from ci where id is not null and json_extract_string(c, '$.status') = 'ok' and json_extract_string(c, '$.output_dir') in ('out/3', 'out/8', 'out/9')
union all select path, 'recommendation references unknown config: ' || id from rec where id is not null and not exists (select 1 from ci where ci.path = rec.path and ci.id = rec.id)""")
def _(spark, d):
    folders = spark.range(17).where("id not in (3, 8, 9)").select(F.concat(F.lit("out/"), F.col("id").cast("string")).alias("output_dir"))
    return K.contract_errors(result_files(spark, d), folders)


# a metrics file for each event: all shapes' fields, the number tells which is which
_FIELDS = [
    "total_seconds", "mean_ms_per_frame", "summary.model_load_ms", "summary.warmup_total_ms", "summary.measured_wall_ms", "summary.inference_mean_excluding_first_ms", "summary.mean_total_ms", "summary.max_cuda_pipeline_peak_allocated_mib",
    "model_load_seconds", "batch_wall_seconds", "inference_mean_excluding_first_seconds", "end_to_end_mean_excluding_first_seconds", "cuda_peak_memory.allocated_bytes", "process_seconds_excluding_cli_import", "measured_seconds", "mean_inference_ms",
    "mean_total_ms", "peak_vram_mb", "run_wall_seconds", "remove_mean_excluding_first_seconds", "timing.end_to_end_seconds", "timing.output_inference_seconds", "timing.inference.propagation_wall_seconds", "timing.inference.peak_memory.peak_allocated_mib",
    "timing.cuda_peak_during_inference.peak_allocated_mib", "green_profile_seconds", "end_to_end_mean_seconds", "cuda_memory.peak_allocated_bytes",
]
_NAMES = list(dict.fromkeys(r[0] for r in K.RUNTIME_SHAPES))


def _nested(fields: list[str]) -> dict:
    out: dict = {}
    for i, f in enumerate(fields):
        at = out
        *folders, name = f.split(".")
        for x in folders:
            at = at.setdefault(x, {})
        at[name] = i
    return out


def _json_of(tree: dict):
    """A column: the tree as JSON, each number the event's plus its own."""
    parts = [F.lit("{")]
    for n, (name, v) in enumerate(tree.items()):
        parts += [F.lit(f'{"," if n else ""}"{name}":'), _json_of(v) if isinstance(v, dict) else (F.col("n") + v).cast("string")]
    return F.concat(*parts, F.lit("}"))


def _sql_field(provider: str, field: str) -> str:
    parts = [r for r in K.RUNTIME_SHAPES if r[0] == provider and r[1] == field]
    if not parts:
        return "null"
    return " + ".join(f"{r[5]}::double" if r[2] is None else f"(n + {_FIELDS.index(r[2][2:])}) * {r[3]!r}::double" + (" / frames" if r[4] else "") for r in parts)


_CASES = ", ".join("round(case provider " + " ".join(f"when '{p}' then {_sql_field(p, f)}" for p in _NAMES) + f" end, 6) as {f}" for f in K.RUNTIME_FIELDS)


@query("p10_runtime_harmoniser", f"""with e as (select event_id, [{', '.join(f"'{p}'" for p in _NAMES)}][event_id % {len(_NAMES)} + 1] as provider, event_id % 977 + 1 as n, event_id % 5 + 20 as frames from events) select event_id, provider, {_CASES} from e""")
def _(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.element_at(F.lit(_NAMES), (i % len(_NAMES) + 1).cast("int")).alias("provider"), (i % 977 + 1).alias("n"), (i % 5 + 20).alias("frame_count"))
    runs = rows.select("event_id", "provider", "frame_count", F.call_function("parse_json", _json_of(_nested(_FIELDS))).alias("v"))
    out = K.harmonised(runs, K.runtime_shapes(spark)).select("event_id", "provider", *K.RUNTIME_FIELDS)
    return out.withColumns({f: F.round(f, 6) for f in K.RUNTIME_FIELDS})
