"""Diagnostics of mattes and masks, and rules on connected parts, over 8 x 8 frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.functions import exprs as X
from framewell.operators import clip as C
from framewell.operators import diagnostics as D
from framewell.operators import parts as K
from framewell.operators import pixels as P
from framewell.plans.clip_queries import _component
from framewell.plans.pixel_queries import FRAMES, PX1, frames, px1, rounded
from framewell.plans.registry import query

ALPHA = ["visible_coverage_mean", "visible_coverage_cv", "visible_coverage_min", "visible_coverage_max", "soft_alpha_coverage_mean", "consecutive_alpha_mae_mean", "consecutive_alpha_mae_p95", "centroid_span_x", "centroid_span_y"]
_LARGEST = "(select clip, f, count(*) as parts, arg_max(cx, (area, -label)) as cx, arg_max(cy, (area, -label)) as cy from (select clip, f, label, count(*) as area, avg(x) as cx, avg(y) as cy from lab{0} group by clip, f, label) group by clip, f)"


# of a pixel, alpha is what is over 0.35 of its value, so that frames have clear, soft and opaque parts
@query("a7_alpha_report", f"""with recursive {PX1}, qa as (select clip, f, y, x, floor(least(1, greatest(0, (v - 0.35::double) * 4)) * 255 + 0.5)::bigint as q from px), vis as (select clip, f, y, x from qa where q >= 16), {_component('vis', 'v')}, big as {_LARGEST.format('v')},
fr as (select clip, f, avg((q >= 16)::int) as cover, avg((q > 0 and q < 250)::int) as soft, avg(abs(q - prev)) / 255 as step, max((q >= 16 and (x in (0, 7) or y in (0, 7)))::int) as edge from (select *, lag(q) over (partition by clip, y, x order by f) as prev from qa) group by clip, f),
va as (select clip, count(distinct q) as alpha_unique_value_count, min(q) as alpha_value_min, max(q) as alpha_value_max from qa group by clip)
select clip, any_value(alpha_unique_value_count) as alpha_unique_value_count, any_value(alpha_value_min) as alpha_value_min, any_value(alpha_value_max) as alpha_value_max, round(avg(cover), 6) as visible_coverage_mean, round(stddev_pop(cover) / avg(cover), 6) as visible_coverage_cv, round(min(cover), 6) as visible_coverage_min,
  round(max(cover), 6) as visible_coverage_max, round(avg(soft), 6) as soft_alpha_coverage_mean, round(avg(step), 6) as consecutive_alpha_mae_mean, round(quantile_cont(step, 0.95), 6) as consecutive_alpha_mae_p95, round(max(cx) - min(cx), 6) as centroid_span_x, round(max(cy) - min(cy), 6) as centroid_span_y,
  max(parts) as component_count_max, sum(edge)::bigint as edge_touch_frames, count(*) filter (cover = 0) as empty_frames from fr left join big using (clip, f) join va using (clip) group by clip""")
def _(spark, d):
    px = px1(spark, d).select(*P.PIXEL, X.quantise(X.clamp((F.col("v") - 0.35) * 4)).alias("q"))
    return rounded(D.alpha_diagnostics(px, 8, 8), *ALPHA)


MASK = [
    "mask_coverage_mean", "mask_coverage_min", "mask_coverage_max", "mask_coverage_cv", "absolute_area_change_mean", "absolute_area_change_p95", "consecutive_mask_iou_mean", "consecutive_mask_iou_p05", "reference_iou_mean", "reference_iou_p05", "reference_iou_min",
    "reference_area_mae", "reference_alpha_mae", "interior_hole_fraction", "background_leak_fraction", "centroid_step_mean", "centroid_step_p95", "soft_band_fraction_mean", "soft_band_containment_mean",
]


@query("a8_mask_report", f"""with recursive {PX1}, qa as (select clip, f, y, x, v > 0.55 as m, floor(least(1, greatest(0, (v - 0.35::double) * 4)) * 255 + 0.5)::bigint as q, v > 0.5 as r from px), vis as (select clip, f, y, x from qa where m), {_component('vis', 'v')}, big as {_LARGEST.format('v')},
fr as (select clip, f, avg(m::int) as area, avg(r::int) as ra, case when count(p) > 0 then coalesce(count(*) filter (m and p)::double / nullif(count(*) filter (m or p), 0), 1) end as iou, coalesce(count(*) filter (m and r)::double / nullif(count(*) filter (m or r), 0), 1) as riou, avg((q > 8 and q < 247)::int) as soft,
  coalesce(count(*) filter (m and q > 8 and q < 247)::double / nullif(count(*) filter (q > 8 and q < 247), 0), 1) as contained, avg(abs(m::int - q / 255.0::double)) as mae, count(*) filter (not m and q >= 250)::double / greatest(1, count(*) filter (q >= 250)) as holes,
  count(*) filter (m and q <= 5)::double / greatest(1, count(*) filter (q <= 5)) as leaks, avg(x) filter (m) as cx, avg(y) filter (m) as cy from (select *, lag(m) over (partition by clip, y, x order by f) as p from qa) group by clip, f),
st as (select fr.*, parts, sqrt(pow(fr.cx - lag(fr.cx) over w, 2) + pow(fr.cy - lag(fr.cy) over w, 2)) as step, abs(area - lag(area) over w) as change from fr left join big using (clip, f) window w as (partition by fr.clip order by fr.f))
select clip, round(avg(area), 6) as mask_coverage_mean, round(min(area), 6) as mask_coverage_min, round(max(area), 6) as mask_coverage_max, round(stddev_pop(area) / avg(area), 6) as mask_coverage_cv, round(avg(change), 6) as absolute_area_change_mean, round(quantile_cont(change, 0.95), 6) as absolute_area_change_p95,
  round(avg(iou), 6) as consecutive_mask_iou_mean, round(quantile_cont(iou, 0.05), 6) as consecutive_mask_iou_p05, round(avg(riou), 6) as reference_iou_mean, round(quantile_cont(riou, 0.05), 6) as reference_iou_p05, round(min(riou), 6) as reference_iou_min, round(regr_slope(riou, f), 8) as reference_iou_trend,
  round(avg(abs(area - ra)), 6) as reference_area_mae, round(avg(mae), 6) as reference_alpha_mae, round(avg(holes), 6) as interior_hole_fraction, round(avg(leaks), 6) as background_leak_fraction, round(avg(step), 6) as centroid_step_mean, round(quantile_cont(step, 0.95), 6) as centroid_step_p95,
  max(parts) as component_count_max, count(*) filter (area = 0) as empty_frames, count(*) filter (area = 1) as full_frames, round(avg(soft), 6) as soft_band_fraction_mean, round(avg(contained), 6) as soft_band_containment_mean from st group by clip""")
def _(spark, d):
    v = F.col("v")
    px = px1(spark, d).select(*P.PIXEL, (v > 0.55).alias("m"), X.quantise(X.clamp((v - 0.35) * 4)).alias("q"), (v > 0.5).alias("r"))
    return rounded(D.mask_diagnostics(px, 8).withColumn("reference_iou_trend", F.round("reference_iou_trend", 8)), *MASK)


def _boxes(n: str) -> str:
    return f"c{n} as (select clip, f, label, count(*) as area, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from lab{n} group by clip, f, label)"


_SUBJECT = f"{PX1}, sub as (select clip, f, y, x from px where v > 0.66), {_component('sub', 's')}, {_boxes('s')}, mn as (select clip, f, arg_max({{'l': label, 'a': area, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}, (area, -label)) as m from cs group by clip, f)"
_AWAY = "not (x1 >= m.x0 - {p} and x0 <= m.x1 + {p} and y1 >= m.y0 - {p} and y0 <= m.y1 + {p})"
_PAD = "greatest({least}, floor(greatest(m.x1 - m.x0, m.y1 - m.y0) * {share}))"


def subject(spark, d):
    return P.components(px1(spark, d).where("v > 0.66"), 8)


@query("i5_detached_parts", f"with recursive {_SUBJECT} select clip, f, label, area from cs join mn using (clip, f) where label <> m.l and {_AWAY.format(p=_PAD.format(least=0, share=0.25))} and area < m.a * 0.3")
def _(spark, d):
    return K.detached(subject(spark, d), (0, 0.25), 0.3)


@query("i5_overlays", f"""with recursive {_SUBJECT}, wh as (select clip, f, y, x from px where v < 0.38), {_component('wh', 'w')}, {_boxes('w')}, sev as (select clip, f from cs group by clip, f having count(*) > 1)
select clip, f, label, area, case when (x1 - x0 > 2 and y1 - y0 <= 1) or (y1 - y0 > 2 and x1 - x0 <= 1) then 'stroke' else 'label' end as why from cw join mn using (clip, f) join sev using (clip, f)
where area >= 2 and {_AWAY.format(p=_PAD.format(least=0, share=0.1))} and ((x1 - x0 > 2 and y1 - y0 <= 1) or (y1 - y0 > 2 and x1 - x0 <= 1) or (area < 6 and x1 - x0 < 4 and y1 - y0 < 4))""")
def _(spark, d):
    white = P.components(px1(spark, d).where("v < 0.38"), 8)
    return K.overlays(white, subject(spark, d), (0, 0.1), 2, (2, 1), (6, 4, 4))


@query("i5_kept_box", f"""with recursive {_SUBJECT}, k as (select clip, f, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, any_value({_PAD.format(least=0, share=0.3)})::int as pad from cs join mn using (clip, f) where label = m.l or not {_AWAY.format(p=_PAD.format(least=0, share=0.1))} or area >= m.a * 0.5 group by clip, f)
select clip, f, greatest(0, x0 - pad)::int as x0, greatest(0, y0 - pad)::int as y0, least(8, x1 + pad)::int as x1, least(8, y1 + pad)::int as y1 from k""")
def _(spark, d):
    return K.kept_box(subject(spark, d), 8, 8, (0, 0.1), 0.5, (0, 0.3))


@query("a9_geometry_report", f"""with recursive {PX1}, qa as (select clip, f, y, x, greatest(0, v - 0.55::double) * 2 as a, v > 0.62 and x between 1 and 6 as s from px), vis as (select clip, f, y, x from qa where a > 0.08), {_component('vis', 'v')},
mn as (select clip, f, arg_max(label, (k, -label)) as label from (select clip, f, label, count(*) as k from labv group by all) group by clip, f), me as (select labv.clip, labv.f, labv.y, labv.x, true as m from labv join mn using (clip, f, label)),
r as (select qa.*, coalesce(m, false) as m from qa left join me using (clip, f, y, x)),
b as (select clip, f, least(min(x) filter (m), min(y) filter (m), 7 - max(x) filter (m), 7 - max(y) filter (m)) as cl, least(min(x) filter (s), min(y) filter (s), 7 - max(x) filter (s), 7 - max(y) filter (s)) as sc, avg(m::int) as cover, min(x) filter (s) as x0, max(x) filter (s) as x1 from r group by clip, f),
w as (select *, greatest(1, x1 - x0 + 1) * 0.22::double as reach from b), j as (select r.*, w.x0, w.x1, s and x <= w.x0 + reach as lf, s and x >= w.x1 - reach as rt from r join w using (clip, f)),
bd as (select clip, f, case when count(*) filter (lf) >= count(*) filter (rt) then avg(a) filter (lf) else avg(a) filter (rt) end as ra, case when count(*) filter (lf) >= count(*) filter (rt) then avg(m::int) filter (lf) else avg(m::int) filter (rt) end as rm from j group by clip, f)
select clip, count(*) filter (cl is null or cl <= 0) as border_touch_frames, count(*) filter (cl is not null and sc <= 0) as source_border_risk_frames, min(coalesce(cl, 0)) as min_subject_clearance_px, round(avg(coalesce(cl, 0)), 6) as mean_subject_clearance_px, round(avg(cover * 100) filter (cl is not null), 6) as subject_coverage_pct,
  round(avg(case when cl is null then 0 else coalesce(ra, 0) end), 6) as lateral_alpha_retention, round(avg(case when cl is null then 0 else coalesce(rm, 0) end), 6) as lateral_main_component_ratio from b join bd using (clip, f) group by clip""")
def _(spark, d):
    v, x = F.col("v"), F.col("x")
    px = px1(spark, d).select(*P.PIXEL, (F.greatest(F.lit(0.0), v - 0.55) * 2).alias("a"), ((v > 0.62) & x.between(1, 6)).alias("s"))
    return rounded(D.geometry(px, 8, 8, edge=0), "mean_subject_clearance_px", "subject_coverage_pct", "lateral_alpha_retention", "lateral_main_component_ratio")


@query("a15_union_box", f"with {PX1}, u as (select clip, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from px where v > 0.97 and (x + y) % 3 <> clip % 3 group by clip) select *, x0 <= 0 as left, y0 <= 0 as top, 8 - x1 <= 0 as right, 8 - y1 <= 0 as bottom from u")
def _(spark, d):
    inside = (F.col("v") > 0.97) & ((F.col("x") + F.col("y")) % 3 != F.col("clip") % 3)
    return D.union_box(px1(spark, d), inside, 8, 8, 0)


@query("i8_temporal_gate", f"""with {PX1}, t as (select clip, f, avg(abs(v - prev)) as step from (select *, lag(v) over (partition by clip, y, x order by f) as prev from px) where prev is not null and (v > 0.02 or prev > 0.02) group by clip, f),
m as (select clip, avg(step) as mae from t group by clip) select f.clip, round(case when f.clip % 4 <> 3 then any_value(mae) end, 6) as temporal_alpha_mae_static from frames f left join m on m.clip = f.clip group by f.clip""")
def _(spark, d):
    # every fourth clip has a frame of another name
    odd = (F.col("clip") % 4 == 3) & (F.col("f") == 1)
    names = frames(spark, d).select("clip", "f", F.when(odd, "cover.png").otherwise(F.format_string("f_%04d.png", "f")).alias("name"))
    return rounded(D.temporal_alpha(px1(spark, d).withColumnRenamed("v", "a"), names), "temporal_alpha_mae_static")


_NAME = "printf('%s__f_%04d.png', clip::varchar, f)"


@query("s10_selected_frames", f"with {FRAMES}, n as (select clip, count(*)::int as n from frames group by clip) select clip, n as frames, f, {_NAME} as name, 8 as width, (len(e) / 8)::int as height from frames join n using (clip) where f % greatest(1, n // 6) = 0 and f // greatest(1, n // 6) < 6")
def _(spark, d):
    chosen = C.every_nth(C.counted(frames(spark, d)).withColumnRenamed("n", "frames"), 6, cap=True)
    return chosen.select("clip", "frames", "f", F.format_string("%s__f_%04d.png", F.col("clip").cast("string"), "f").alias("name"), F.lit(8).alias("width"), (F.size("e") / 8).cast("int").alias("height"))


@query("s15_inventory_names", f"with {FRAMES} select clip, count(*) as frames, count(distinct len(e)) as sizes, count(distinct len(e)) > 1 as mixed, string_agg({_NAME}, ',' order by {_NAME}) as names from frames group by clip")
def _(spark, d):
    name = F.format_string("%s__f_%04d.png", F.col("clip").cast("string"), "f")
    n = F.count_distinct(F.size("e"))
    return frames(spark, d).groupBy("clip").agg(F.count("*").alias("frames"), n.alias("sizes"), (n > 1).alias("mixed"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))
