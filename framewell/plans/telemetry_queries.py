"""Telemetry operators over the events, orders, customers, pages and documents tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions import exprs as X
from framewell.operators import telemetry as T
from framewell.operators.ranks import placed
from framewell.plans.registry import query, table

K = "cast(json_extract_string(props, '$.k') as bigint)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("s1_event_json_scan", f"select event_id, event_type, {K} as k, json_valid(props) as parsed from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", _k().alias("k"), F.expr("try_parse_json(props) is not null").alias("parsed"))


@query("s8_keyed_upsert", """
select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value
from events group by user_id, event_type""")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return T.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("s12_upload_type", r"""
select page_id, case when ext in ('jpg', 'png', 'webp', 'heic', 'html') then ext
  when lower(substr(html, 1, 15)) = '<!doctype html>' then 'html' when starts_with(html, '<') then 'xml' else 'jpg' end as kind
from (select page_id, html, replace(lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)), 'jpeg', 'jpg') as ext from pages)""")
def _(spark, d):
    ext = F.replace(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)), F.lit("jpeg"), F.lit("jpg"))
    kind = F.when(ext.isin("jpg", "png", "webp", "heic", "html"), ext).when(F.lower(F.substring("html", 1, 15)) == "<!doctype html>", "html").when(F.startswith("html", F.lit("<")), "xml").otherwise("jpg")
    return table(spark, d, "pages").select("page_id", kind.alias("kind"))


@query("s13_presence_matrix", """
select user_id, bool_or(event_type = 'view') as has_view, bool_or(event_type = 'click') as has_click,
  bool_or(event_type = 'purchase') as has_purchase, bool_or(event_type = 'signup') as has_signup, bool_or(event_type = 'error') as has_error
from events group by user_id""")
def _(spark, d):
    kinds = ["view", "click", "purchase", "signup", "error"]
    return table(spark, d, "events").groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == k).alias(f"has_{k}") for k in kinds])


@query("s14_checksums", "select doc_id, sha256(text) as sha256, md5(text) as md5 from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("s11_catalogue_dimension", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def _(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("p1_active_filter", "select event_id, event_type from events where nullif(event_type, 'error') is null or event_type in ('view', 'click')")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("clip", F.nullif("event_type", F.lit("error")))
    return T.active_only(rows, ["view", "click"], "clip", None).select("event_id", "event_type")


@query("p2_id_parse", r"""
select o_orderkey, regexp_extract(o_orderpriority, '^([0-9])-([A-Z ]+)$', 1) as level,
  coalesce(nullif(regexp_extract(o_orderpriority, '^([0-9])-([A-Z]+)$', 2), ''), 'paimomo') as variant from orders""")
def _(spark, d):
    p = F.col("o_orderpriority")
    variant = F.coalesce(F.nullif(F.regexp_extract(p, "^([0-9])-([A-Z]+)$", 2), F.lit("")), F.lit("paimomo"))
    return table(spark, d, "orders").select("o_orderkey", F.regexp_extract(p, "^([0-9])-([A-Z ]+)$", 1).alias("level"), variant.alias("variant"))


@query("p3_id_whitelist", r"""
select host, min(page_id) as page_id from (select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host from pages)
where regexp_full_match(host, '[A-Za-z0-9_.-]+') group by host""")
def _(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return rows.where(F.rlike("host", F.lit("^[A-Za-z0-9_.-]+$"))).groupBy("host").agg(F.min("page_id").alias("page_id"))


@query("p5_first_selector", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), nullif(c_name, ''), 'none') as chosen from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.nullif("c_name", F.lit("")), F.lit("none")).alias("chosen"))


@query("p7_finite_or_null", "select s_suppkey, case when s_acctbal < 0 then null else s_acctbal end as balance from supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").withColumn("raw", F.when(F.col("s_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal")))
    return rows.select("s_suppkey", X.finite_or_null(F.col("raw")).alias("balance"))


@query("p10_runtime_shapes", f"""
select event_id, case event_type when 'view' then value * 1000 when 'click' then value when 'purchase' then value * 1000 / 96
  when 'signup' then {K} / 1000.0 when 'error' then value / 2 end as frame_ms from events""")
def _(spark, d):
    v = F.col("value")
    ms = F.when(F.col("event_type") == "view", v * 1000).when(F.col("event_type") == "click", v).when(F.col("event_type") == "purchase", v * 1000 / 96).when(F.col("event_type") == "signup", _k() / F.lit(1000.0)).when(F.col("event_type") == "error", v / 2).otherwise(F.raise_error(F.concat(F.lit("no runtime shape for "), F.coalesce("event_type", F.lit("null")))))
    return table(spark, d, "events").select("event_id", ms.alias("frame_ms"))


@query("p11_units", f"select event_id, round({K} * 1000.0, 6) as ms, round({K} / 1048576.0, 6) as mib from events")
def _(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", F.round(F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')") * 1000.0, 6).alias("ms"), F.round(F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')") / 1048576.0, 6).alias("mib"))


@query("p12_redaction", r"""
select page_id, regexp_replace(url, '(https?://[^\s?"]+)\?[^\s"]*', '\1', 'g') as url from pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.redacted(F.col("url")).alias("url"))


@query("p12_redaction_text", r"""
select doc_id, regexp_replace(replace(text, 'the', '[redacted]'), '[\w.+-]+@[\w.-]+', '[redacted]', 'g') as text from documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(T.redacted(F.col("text"), ["the"]), r"[\w.+-]+@[\w.-]+", "[redacted]").alias("text"))


@query("p13_usage_flatten", f"select event_id, coalesce({K}, 0) as tokens, case when {K} > 50 then 1 else 0 end::bigint as images from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(_k(), F.lit(0)).alias("tokens"), F.when(_k() > 50, 1).otherwise(0).cast("long").alias("images"))


@query("p15_prompt_assembly", r"""
select conv_id, turn, regexp_replace('[' || role || '] ' || text || ' --duration 9 --resolution 480p', '--duration\s+\d+ --resolution \S+$', '--duration 5 --resolution 720p') as prompt
from conversations""")
def _(spark, d):
    body = F.concat(F.lit("["), "role", F.lit("] "), "text", F.lit(" --duration 9 --resolution 480p"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(body, r"--duration\s+\d+ --resolution \S+$", "--duration 5 --resolution 720p").alias("prompt"))


@query("p16_phrase_lint", """
select doc_id, contains(lower(text), 'the') and contains(lower(text), 'and') as has_required,
  contains(lower(text), 'trash') or contains(lower(text), 'token =') as has_forbidden from documents""")
def _(spark, d):
    text = F.lower("text")
    required, forbidden = F.array(F.lit("the"), F.lit("and")), F.array(F.lit("trash"), F.lit("token ="))
    return table(spark, d, "documents").select("doc_id", F.forall(required, lambda p: F.contains(text, p)).alias("has_required"), F.exists(forbidden, lambda p: F.contains(text, p)).alias("has_forbidden"))


@query("p19_display", r"""
select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
  coalesce(printf('%.2f', p_retailprice), '-') as price from part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.fixed(F.col("p_retailprice"), 2).alias("price"))


@query("p19_compact", "select p_partkey, case when p_size < 10 then 'default' else 'size=' || p_size::varchar || ', brand=' || p_brand end as parameters from part")
def _(spark, d):
    # small parts run with no parameters of their own
    parameters = F.when(F.col("p_size") >= 10, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", X.compact(parameters).alias("parameters"))


@query("p19_quote", "select page_id, replace(url_encode(url), '%2F', '/') as quoted from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.quoted(F.col("url")).alias("quoted"))


@query("a3_run_totals", """
select user_id, round(sum(case when event_type <> 'view' then value else 0 end), 6) as api_seconds,
  round(sum(case when event_type = 'view' then value else 0 end), 6) as local_seconds, round(sum(value), 6) as total_seconds,
  sum(case when event_type in ('click', 'purchase', 'signup') then cast(json_extract_string(props, '$.k') as bigint) else 0 end)::bigint as tokens,
  count(*) filter (event_type = 'click') as image_tasks, count(*) filter (event_type = 'purchase') as video_tasks
from events group by user_id""")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("k", _k())
    out = T.step_totals(rows, "user_id", "event_type", "value", "k", ["view"], ["click", "purchase", "signup"], ["click"], ["purchase"])
    return out.withColumns({c: F.round(c, 6) for c in ("api_seconds", "local_seconds", "total_seconds")})


@query("a4_usage_merge", f"""
select user_id, event_type as name, sum({K})::bigint as n from events where {K} is not null group by user_id, event_type""")
def _(spark, d):
    rows = table(spark, d, "events").where(_k().isNotNull()).select("user_id", F.create_map("event_type", _k()).alias("usage"))
    return T.usage_merge(rows, "user_id", "usage")


_LATENCY = """
with e as (
  select user_id, count(value) as n, sum(value) as total, avg(value) as mean, median(value) as median, quantile_cont(value, 0.95) as p95, max(value) as max,
    case when count(value) > 1 then (sum(value) - arg_min(value, (ts, event_id))) / (count(value) - 1) else avg(value) end as w
  from events group by user_id)
select user_id, n, round(total, 4) as total, round(mean, 4) as mean, round(median, 4) as median, round(p95, 4) as p95, max,
  round(w, 4) as warm_mean, round(1000.0 / nullif(w, 0), 4) as steady_fps from e"""


@query("a5_latency_summary", _LATENCY)
def _(spark, d):
    out = T.latency(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"])
    return out.withColumns({c: F.round(c, 4) for c in ("total", "mean", "median", "p95", "warm_mean", "steady_fps")})


@query("a6_percentile", "select event_type, round(coalesce(quantile_cont(value, 0.5), 0), 6) as p50, round(coalesce(quantile_cont(value, 0.95), 0), 6) as p95 from events group by event_type")
def _(spark, d):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, d, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", F.round(F.coalesce(F.col("p")[0], F.lit(0.0)), 6).alias("p50"), F.round(F.coalesce(F.col("p")[1], F.lit(0.0)), 6).alias("p95"))


@query("a19_token_cost", f"select user_id, sum({K})::bigint as tokens, round(sum({K}) * 8 / 1e6, 9) as cost, round(sum({K}) * 2.25 * 8 / 1e6, 9) as cost_hd from events group by user_id")
def _(spark, d):
    n = F.sum(_k())
    return table(spark, d, "events").groupBy("user_id").agg(n.alias("tokens"), F.round(n * 8 / F.lit(1e6), 9).alias("cost"), F.round(n * F.lit(2.25) * 8 / F.lit(1e6), 9).alias("cost_hd"))


@query("w8_warm_rows", """
select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as c from events) where rn > 1 or c = 1""")
def _(spark, d):
    return T.warm_rows(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id")


_LAST = "select event_id, user_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5"


@query("w13_bounded_log", _LAST)
def _(spark, d):
    return T.last_n(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], 5).select("event_id", "user_id", "ts")


@query("j1_pairing", """
select o_orderkey, count(l_orderkey) as lines, count(l_orderkey) = 0 as missing from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    out = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.col("lines").isNull().alias("missing"))


@query("j1_missing", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(spark, d):
    return T.unmatched(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("j2_recommended_flag", "select c_custkey, c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as recommended from customer")
def _(spark, d):
    marks = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("recommended")).distinct()
    return table(spark, d, "customer").join(marks, "c_custkey", "left").select("c_custkey", F.coalesce("recommended", F.lit(False)).alias("recommended"))


@query("j5_step_join", """
select o_orderkey, c_name, l_linenumber, l_quantity from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'""")
def _(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return lines.join(orders, "o_orderkey").join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name", "l_linenumber", "l_quantity")


@query("j6_variants", """
select s_suppkey, r_name, n_name from supplier cross join region left join nation on n_nationkey = s_nationkey and n_regionkey = r_regionkey""")
def _(spark, d):
    grid = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").crossJoin(F.broadcast(table(spark, d, "region").select("r_regionkey", "r_name")))
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return grid.join(nation, F.expr("n_nationkey = s_nationkey and n_regionkey = r_regionkey"), "left").select("s_suppkey", "r_name", "n_name")


@query("j7_backfill_plan", """
with k as (select unnest(['view', 'click', 'purchase', 'signup', 'error']) as event_type),
u as (select distinct user_id from events), done as (select distinct user_id, event_type from events where value > 150)
select u.user_id, string_agg(k.event_type, ',' order by k.event_type) as missing, count(*) as n_missing
from u cross join k left join done on done.user_id = u.user_id and done.event_type = k.event_type
where done.user_id is null and u.user_id in (select user_id from events where event_type = 'signup') group by u.user_id""")
def _(spark, d):
    events = table(spark, d, "events")
    kinds = spark.createDataFrame([(k,) for k in ("view", "click", "purchase", "signup", "error")], "event_type string")
    return T.missing_work(events, kinds, events.where("value > 150"), events.where("event_type = 'signup'"), "user_id", "event_type")


@query("j8_duplicate_suppression", """
with p as (select page_id, url, regexp_replace(url, '\\?.*$', '') as bare, contains(url, '?') as has_query from pages)
select page_id, url from p where has_query or bare not in (select bare from p where has_query)""")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_replace("url", r"\?.*$", "").alias("bare"), F.contains("url", F.lit("?")).alias("has_query"))
    longer = p.where("has_query").select("bare").distinct().withColumn("longer", F.lit(True))
    return p.join(longer, "bare", "left").where("has_query or longer is null").select("page_id", "url")


@query("j9_grid", "select n_nationkey, r_regionkey, q, printf('n%02d_r%d_q%d', n_nationkey, r_regionkey, q) as id from nation cross join region cross join (select unnest([60, 80, 90]) as q)")
def _(spark, d):
    grid = table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(table(spark, d, "region").select("r_regionkey"))).crossJoin(F.broadcast(spark.createDataFrame([(60,), (80,), (90,)], "q int")))
    return grid.select("*", F.format_string("n%02d_r%d_q%d", "n_nationkey", "r_regionkey", "q").alias("id"))


@query("j16_priority_lookup", """
select o_custkey, arg_min(o_orderkey, (case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderpriority, o_orderkey)) as o_orderkey from orders group by o_custkey""")
def _(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return T.prioritised(table(spark, d, "orders"), "o_custkey", "o_orderkey", [rank, F.col("o_orderpriority"), F.col("o_orderkey")])


@query("t4_first_acceptable", """
with m as (select user_id, min((ts, event_id)) filter (value > 80) as hit from events group by user_id)
select e.user_id, count(*) filter (value > 80) as accepted, count(*) as steps,
  coalesce(arg_min(event_id, (ts, event_id)) filter (value > 80), arg_max(event_id, (ts, event_id))) as chosen,
  case when count(*) filter (value > 80) > 0 then 'ok' else 'review' end as status from events e group by e.user_id""")
def _(spark, d):
    return T.first_acceptable(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("value") > 80, "event_id")


@query("t5_latest_listing", "select o_custkey, max(o_orderdate) as last_order, row_number() over (order by max(o_orderdate) desc, o_custkey) as pos from orders group by o_custkey order by pos")
def _(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"))
    return placed(last, [F.desc("last_order"), "o_custkey"], "pos").withColumn("pos", F.col("pos") + 1)


@query("t7_explicit_order", "select event_id, coalesce(list_position(['purchase', 'click', 'view'], event_type), 0)::bigint as pos from events")
def _(spark, d):
    order = F.array(*[F.lit(k) for k in ("purchase", "click", "view")])
    return table(spark, d, "events").select("event_id", F.array_position(order, F.col("event_type")).alias("pos"))


@query("x1_heterogeneous_union", """
select 's' as kind, s_suppkey as id, s_name as name, s_acctbal as balance, null as segment from supplier
union all select 'c', c_custkey, c_name, c_acctbal, c_mktsegment from customer""")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("x2_set_equality", """
with o as (select distinct o_orderkey as k from orders), l as (select distinct l_orderkey as k from lineitem)
select count(*) filter (l.k is null) as only_a, count(*) filter (o.k is null) as only_b, count(*) filter (o.k is not null and l.k is not null) as both from o full join l on o.k = l.k""")
def _(spark, d):
    return T.set_difference_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("x3_ordered_union", """
select k, min(p) as p from (select c_custkey as k, 0 as p from customer union all select s_suppkey, 1 from supplier) group by k""")
def _(spark, d):
    both = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("p")).union(table(spark, d, "supplier").select(F.col("s_suppkey"), F.lit(1)))
    return both.groupBy("k").agg(F.min("p").alias("p"))


@query("x5_allowed_in_order", """
select user_id, array_to_string(list_filter(list(event_type order by ts, event_id), lambda x: x in ('click', 'purchase')), ',') as kinds from events group by user_id""")
def _(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isNotNull())
    allowed = F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type").isin("click", "purchase"), F.struct("ts", "event_id", "event_type")))), lambda x: x["event_type"])
    return rows.groupBy("user_id").agg(F.array_join(allowed, ",").alias("kinds"))


@query("c15_times", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso, epoch(o_orderdate)::bigint as seconds from orders")
def _(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp(t).alias("seconds"))


@query("c16_json_errors", "select event_id, not json_valid(left(props, length(props) - (event_id % 2)::int)) as failed from events")
def _(spark, d):
    text = F.expr("left(props, length(props) - cast(event_id % 2 as int))")
    return table(spark, d, "events").select("event_id", F.call_function("try_parse_json", text).isNull().alias("failed"))


@query("c17_mib", "select doc_id, round(n_chars / 1048576.0, 2) as mib from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / F.lit(1048576.0), 2).alias("mib"))


@query("p22_status", """
select o_orderkey, case when l.n is null then 'not_run' when l.q >= 100 then 'ok' else 'invalid' end as status
from orders left join (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by l_orderkey) l on l_orderkey = o_orderkey""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.when(F.col("q").isNull(), "not_run").when(F.col("q") >= 100, "ok").otherwise("invalid").alias("status"))


@query("st1_latest_status", """
select user_id, arg_max(event_type, (ts, event_id)) as status, arg_max(event_type, (ts, event_id)) in ('purchase', 'error') as terminal from events group by user_id""")
def _(spark, d):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(last.alias("status"), last.isin("purchase", "error").alias("terminal"))


@query("st2_job_lifecycle", """
select user_id, min(ts) filter (event_type = 'view') as queued_at, min(ts) filter (event_type = 'click') as started_at,
  min(ts) filter (event_type in ('purchase', 'error')) as finished_at,
  coalesce(arg_min(event_type, (ts, event_id)) filter (event_type in ('purchase', 'error')), 'running') as outcome from events group by user_id""")
def _(spark, d):
    kind, at = F.col("event_type"), F.struct("ts", "event_id")
    end = kind.isin("purchase", "error")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min(F.when(kind == "view", F.col("ts"))).alias("queued_at"), F.min(F.when(kind == "click", F.col("ts"))).alias("started_at"), F.min(F.when(end, F.col("ts"))).alias("finished_at"),
        F.coalesce(F.min_by("event_type", F.when(end, at)), F.lit("running")).alias("outcome"),
    )


@query("st4_first_occurrence", "select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by user_id, event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("st6_retries", """
with e as (select user_id, strftime(ts, '%Y-%m-%d') as day, ts, event_id, event_type = 'purchase' as ok from events where event_type in ('purchase', 'error')),
f as (select *, min(case when ok then (ts, event_id) end) over (partition by user_id, day) as first_ok from e)
select user_id, day, count(*) as attempts, count(*) filter (ok) as successes,
  count(*) filter (not ok and (first_ok is null or (ts, event_id) < first_ok)) as failed_first,
  count(*) filter (ok) = 0 and count(*) >= 2 as exhausted,
  count(*) filter (ok) > 0 and count(*) filter (not ok and (first_ok is null or (ts, event_id) < first_ok)) > 0 as recovered from f group by user_id, day""")
def _(spark, d):
    rows = table(spark, d, "events").where("event_type in ('purchase', 'error')").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return T.attempts(rows, ["user_id", "day"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase", 2)


@query("p14_edge_profile", """
select p_partkey, case when p_size % 10 = 0 then 'real' when regexp_matches(lower(p_type), 'tin|brass|small|promo') then 'cartoon' else 'real' end as profile from part""")
def _(spark, d):
    setting = F.when(F.col("p_size") % 10 == 0, "real").otherwise("auto")  # an explicit choice comes first
    return table(spark, d, "part").select("p_partkey", T.edge_profile(setting, F.col("p_type"), ["tin", "brass", "small", "promo"]).alias("profile"))
