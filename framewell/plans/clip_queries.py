"""Clip operators over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.functions import exprs as X
from framewell.operators import clip as C
from framewell.operators import pixels as P
from framewell.plans.pixel_queries import FRAMES, PX1, PX4, _PROFILE, edge4, frames, px1, px4, rounded
from framewell.plans.registry import query

NF = f"{FRAMES}, n as (select clip, count(*)::int as n from frames group by clip)"


@query("w4_every_nth", f"with {NF} select clip, f, vec_id from frames join n using (clip) where f % greatest(1, n // 13) = 0")
def _(spark, d):
    return C.every_nth(frames(spark, d), 13).select("clip", "f", "vec_id")


@query("w4_every_nth_capped", f"with {NF} select clip, f, vec_id from frames join n using (clip) where f % greatest(1, n // 6) = 0 and f // greatest(1, n // 6) < 6")
def _(spark, d):
    return C.every_nth(frames(spark, d), 6, cap=True).select("clip", "f", "vec_id")


@query("w5_uniform_resample", f"with {NF}, s as (select clip, n, unnest(range(24))::int as slot from n), w as (select clip, slot, round_even(slot * (n - 1) / 23.0::double, 0)::int as f from s) select clip, slot, f, vec_id from w join frames using (clip, f)")
def _(spark, d):
    return C.uniform(frames(spark, d), 24).select("clip", "slot", "f", "vec_id")


@query("w6_first_middle_last", f"with {NF} select clip, f, vec_id from frames join n using (clip) where f in (0, n // 2, n - 1)")
def _(spark, d):
    return C.ends_and_middle(frames(spark, d)).select("clip", "f", "vec_id")


@query("w10_trim", f"with {NF}, c as (select *, least(6, n // 5) as c0 from frames join n using (clip)), t as (select *, case when n - 2 * c0 >= 24 then c0 else 0 end as cut from c) select clip, f, vec_id from t where f >= cut and f < n - cut")
def _(spark, d):
    return C.trimmed(frames(spark, d)).select("clip", "f", "vec_id")


_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs({a}[i]::double - {b}[i]::double))) / 64"


@query("c11_signature_distance", f"with {FRAMES} select a.clip, a.f, round({_L1.format(a='a.e', b='b.e')}, 6) as distance from frames a join frames b on a.clip = b.clip and b.f = a.f + 1")
def _(spark, d):
    fr = frames(spark, d)
    nxt = fr.select("clip", (F.col("f") - 1).alias("f"), F.col("e").alias("e2"))
    return rounded(fr.join(nxt, ["clip", "f"]).select("clip", "f", X.l1_mean(F.col("e"), F.col("e2")).alias("distance")), "distance")


_SPAN = f"""{NF}, p as (select a.clip, a.f as start, b.f as "end", round({_L1.format(a='a.e', b='b.e')} + 0.000025::double * (n - b.f) + 0.00004::double * a.f, 9) as score
  from frames a join frames b on a.clip = b.clip and a.f <= 8 and b.f >= a.f + 20 join n on n.clip = a.clip where n >= 22 and a.f <= n - 21)"""


@query("j14_span_pairs", f'with {_SPAN} select clip, count(*) as pairs, round(min(score), 6) as lowest from p group by clip')
def _(spark, d):
    fr = frames(spark, d)
    n = fr.groupBy("clip").agg(F.count("*").alias("n"))
    a = fr.where("f <= 8").select("clip", F.col("f").alias("start"), F.col("e").alias("ea"))
    p = a.join(fr.select("clip", F.col("f").alias("end"), F.col("e").alias("eb")), "clip").where("end >= start + 20").join(n.where("n >= 22"), "clip").where("start <= n - 21")
    score = X.l1_mean(F.col("ea"), F.col("eb")) + 0.000025 * (F.col("n") - F.col("end")) + 0.00004 * F.col("start")
    return rounded(p.groupBy("clip").agg(F.count("*").alias("pairs"), F.min(score).alias("lowest")), "lowest")


@query("t3_best_span", f"""with {_SPAN}, b as (select clip, arg_min(start, (score, start, "end")) as start, arg_min("end", (score, start, "end")) as "end", min(score) as score from p group by clip)
select n.clip, n.n, case when n.n < 22 then 'too_short' when b.clip is null then 'not_found' else 'best_span' end as mode, b.start, b."end", round(b.score, 6) as score from n left join b on b.clip = n.clip""")
def _(spark, d):
    return rounded(C.best_span(frames(spark, d).select("clip", "f", "e"), 8, 20), "score")


@query("w11_crossfade", f"""with {NF}, k as (select frames.*, n, least(8, n // 5) as k from frames join n using (clip)), h as (select clip, f as i, e as h from k where f < k)
select k.clip, k.f, p::bigint as pos, round(case when h.h is null then k.e[p + 1]::double else k.e[p + 1]::double * (1 - (h.i + 1)::double / (k.k + 1)) + h.h[p + 1]::double * ((h.i + 1)::double / (k.k + 1)) end, 6) as v
from k left join h on k.clip = h.clip and k.f - (k.n - k.k) = h.i, unnest(range(64)) u(p)""")
def _(spark, d):
    out = C.crossfade(frames(spark, d).select("clip", "f", "e"))
    return out.select("clip", "f", F.posexplode("e").alias("pos", "v")).select("clip", "f", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query("w12_seam", f"with {NF}, b as (select a.clip, {_L1.format(a='a.e', b='b.e')} as s from frames a join n on n.clip = a.clip and a.f = 0 join frames b on b.clip = a.clip and b.f = n.n - 1) select clip, round(s, 6) as seam, case when s <= 0.012 then 'direct' else 'crossfade' end as closure from b")
def _(spark, d):
    return rounded(C.seam(frames(spark, d)), "seam")


@query("w1_motion_mask", f"""with {PX1}, s as (select clip, f, y, x, (greatest(coalesce(abs(v - lag(v) over w), 0), coalesce(abs(v - lead(v) over w), 0)) > 0.45)::int as m from px window w as (partition by clip, y, x order by f))
select a.clip, a.f, a.y, a.x, max(b.m) as motion from s a join s b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all""")
def _(spark, d):
    return C.motion(px1(spark, d), "v", 0.45, 1)


@query("w2_consecutive", f"""with {PX1}, p as (select *, lag(v) over (partition by clip, y, x order by f) as prev from px)
select clip, f, round(avg(abs(v - prev)), 6) as mae, round(coalesce(sum((v > 0.5 and prev > 0.5)::int)::double / nullif(sum((v > 0.5 or prev > 0.5)::int), 0), 1), 6) as iou from p where prev is not null group by clip, f""")
def _(spark, d):
    a, b = F.col("v") > 0.5, F.col("prev") > 0.5
    px = P.consecutive(px1(spark, d), "v").where("prev is not null")
    return rounded(px.groupBy("clip", "f").agg(F.avg(F.abs(F.col("v") - F.col("prev"))).alias("mae"), F.coalesce(F.try_divide(F.count_if(a & b), F.nullif(F.count_if(a | b), F.lit(0))), F.lit(1.0)).alias("iou")), "mae", "iou")


@query("w3_centroid_step", f"""with {PX1}, c as (select clip, f, avg(x) filter (v > 0.5) as cx, avg(y) filter (v > 0.5) as cy from px group by clip, f), s as (select clip, f, sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) as step from c window w as (partition by clip order by f))
select clip, f, round(step, 6) as step from s where step is not null""")
def _(spark, d):
    from pyspark.sql.window import Window

    inside = F.col("v") > 0.5
    c = px1(spark, d).groupBy("clip", "f").agg(F.avg(F.when(inside, F.col("x"))).alias("cx"), F.avg(F.when(inside, F.col("y"))).alias("cy"))
    w = Window.partitionBy("clip").orderBy("f")
    s = c.select("clip", "f", F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w)).alias("step"))
    return rounded(s.where("step is not null"), "step")


_BOX3 = "range between 1 preceding and 1 following"
_SNAP = "case when {o} < 0.012 then 0 when {o} > 0.992 then 1 else {o} end"


def _sweep(name: str, of: str, change: str, first: str, step: str) -> str:
    """{name}: rows of `of` (clip, f, y, x, v and the change to the neighbour), folded from the frame `first` on by `step`."""
    pull = f"coalesce(least(1, greatest(0, 1 - {change} / 0.9::double)) * case when {change} < 0.3 then 0.65::double when soft = 1 then 0.5::double else 0 end, 0)"
    out = "(w.v + w.w * (r.o - w.v))"
    return f"""{name}x as (select *, max((v > 0.02 and v < 0.98)::int) over (partition by clip, f, y order by x {_BOX3}) as soft_x from {of}),
{name}y as (select *, max(soft_x) over (partition by clip, f, x order by y {_BOX3}) as soft from {name}x), {name}w as (select *, {pull} as w from {name}y),
{name} as (select clip, f, y, x, v as o from {name}w where f = {first} union all select w.clip, w.f, w.y, w.x, ({_SNAP.format(o=out)})::double from {name} r join {name}w w on w.clip = r.clip and w.y = r.y and w.x = r.x and w.f = r.f {step} 1)"""


_MOVED = f"""n as (select clip, count(*)::int as n from frames group by clip), d0 as (select *, abs(v - lag(v) over (partition by clip, y, x order by f)) as d from px), d1 as (select *, avg(d) over (partition by clip, f, y order by x {_BOX3}) as dx from d0),
d2 as (select *, avg(dx) over (partition by clip, f, x order by y {_BOX3}) as moved from d1), mv as (select clip, f, y, x, v, moved, lead(moved) over (partition by clip, y, x order by f) as moved_next, n - 1 as final from d2 join n using (clip))"""
_BOTH = f"with recursive {PX1}, {_MOVED}, {_sweep('fw', 'mv', 'moved', '0', '+')}, back as (select mv.* exclude (v), fw.o as v from mv join fw using (clip, f, y, x)), {_sweep('bw', 'back', 'moved_next', 'final', '-')}"


@query("w15_smoother", f"{_BOTH} select clip, f, y, x, round(case when n < 3 then px.v else o end, 6) as v from px join bw using (clip, f, y, x) join n using (clip)")
def _(spark, d):
    return rounded(C.smoothed(px1(spark, d), "v", ["v"], still=0.3, trusted=0.9), "v")


@query("w15_smoother_lower", f"""{_BOTH}, low as (select clip, f, min(y) + round_even((max(y) - min(y) + 1) * 0.52::double, 0) as cut from px where v > 0.55 group by clip, f)
select clip, f, px.y, px.x, round(case when n < 3 or coalesce(px.y >= cut, false) then px.v else o end, 6) as v from px join bw using (clip, f, y, x) join n using (clip) left join low using (clip, f)""")
def _(spark, d):
    return rounded(C.smoothed(px1(spark, d), "v", ["v"], still=0.3, trusted=0.9, lower=True), "v")


@query("w16_fragment_voting", f"""with recursive {PX1}, m as (select clip, f, y, x from px where v > 0.7),
cc as (select clip, f, y, x, y * 8 + x as l from m union select m.clip, m.f, m.y, m.x, cc.l from cc join m on m.clip = cc.clip and m.f = cc.f and abs(m.y - cc.y) <= 1 and abs(m.x - cc.x) <= 1),
lab as (select clip, f, y, x, min(l)::bigint as label from cc group by clip, f, y, x),
sup as (select l.clip, l.f, l.y, l.x, label, exists (select 1 from m where m.clip = l.clip and abs(m.f - l.f) = 1 and abs(m.y - l.y) <= 1 and abs(m.x - l.x) <= 1) as s from lab l),
parts as (select clip, f, label, count(*) as area, count(*) filter (s) as supported from sup group by all), mn as (select clip, f, arg_max(label, (area, -label)) as main from parts group by clip, f),
dt as (select parts.*, area <= 64 * 0.08 as small, supported < greatest(1, area * 0.25) as weak from parts join mn using (clip, f) where label <> main)
select clip, f, count(*) as detached, count(*) filter (small and weak) as removed, coalesce(sum(area) filter (small and weak), 0)::bigint as pixels_removed, count(*) filter (not small and weak) as protected from dt group by clip, f""")
def _(spark, d):
    px = px1(spark, d)
    return C.unsupported_fragments(px.where("v > 0.7"), px, 8)


def _component(t: str, n: str) -> str:
    """lab{n}: labels of the pixels of `t` in frames of 8 x 8."""
    return f"""cc{n} as (select clip, f, y, x, y * 8 + x as l from {t} union select m.clip, m.f, m.y, m.x, cc{n}.l from cc{n} join {t} m on m.clip = cc{n}.clip and m.f = cc{n}.f and abs(m.y - cc{n}.y) <= 1 and abs(m.x - cc{n}.x) <= 1),
lab{n} as (select clip, f, y, x, min(l)::bigint as label from cc{n} group by clip, f, y, x)"""


#: The bounds of 8 x 8 frames: solid, visible and near pixels, the least support and the cap.
VOTE = {"solid": 0.75, "visible": 0.70, "near": 0.80, "least": 1, "cap": 3}
_VOTED = f"""{PX1}, sol as (select clip, f, y, x from px where v > 0.75), vis as (select clip, f, y, x from px where v > 0.70), {_component('sol', 's')}, {_component('vis', 'v')},
mn as (select clip, f, arg_max(label, (k, -label)) as label from (select clip, f, label, count(*) as k from labs group by all) group by clip, f), core as (select labs.clip, labs.f, labs.y, labs.x from labs join mn using (clip, f, label)),
nr as (select distinct a.clip, a.f + s as f, a.y + i // 3 - 1 as y, a.x + i % 3 - 1 as x from px a, unnest([-1, 1]) t(s), unnest(range(9)) u(i) where a.v > 0.80), has as (select distinct a.clip, a.f from px a join px b on b.clip = a.clip and abs(b.f - a.f) = 1),
pt as (select l.clip, l.f, l.label, count(*) as area, count(core.clip) as held, count(nr.clip) as supported from labv l left join core using (clip, f, y, x) left join nr using (clip, f, y, x) group by l.clip, l.f, l.label),
dt as (select pt.*, area > 3 as large, area <= 3 and supported < greatest(1, floor(area * 0.25)) as weak from pt join mn using (clip, f) join has using (clip, f) where held = 0)"""


@query("w16_fragment_votes", f"with recursive {_VOTED} select clip, f, count(*) as detached, count(*) filter (weak) as removed, coalesce(sum(area) filter (weak), 0)::bigint as pixels_removed, count(*) filter (large) as protected from dt group by clip, f")
def _(spark, d):
    return C.voted_fragments(px1(spark, d), "v", 8, 64, **VOTE)[1]


@query("w16_without_fragments", f"""with recursive {_VOTED}, gone as (select labv.clip, labv.f, labv.y, labv.x from labv join dt on dt.clip = labv.clip and dt.f = labv.f and dt.label = labv.label and weak)
select px.clip, px.f, px.y, px.x, round(case when gone.clip is null then v else 0 end, 6) as v from px left join gone using (clip, f, y, x)""".replace("select px.clip, px.f, px.y, px.x,", "select clip, f, y, x,"))
def _(spark, d):
    return rounded(C.voted_fragments(px1(spark, d), "v", 8, 64, **VOTE)[0], "v")


@query("j17_structural_repair", f"""with {PX1}, mk as (select clip, f - 1 as f, y, x, (v > 0.4)::int as m from px), co as (select a.clip, a.f, a.y, a.x, min(b.m) as m from mk a join mk b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all)
select clip, f, count(*) filter (co.m = 1) as core, count(*) filter (co.m = 1 and v < 0.6) as repaired, count(*) filter (co.m = 1 and v < 0.3) as severe, round(sum(case when co.m = 1 then greatest(v, 0.6) else v end), 6) as mass from px left join co using (clip, f, y, x) group by clip, f""")
def _(spark, d):
    px = px1(spark, d)
    mask = px.select("clip", (F.col("f") - 1).alias("f"), "y", "x", (F.col("v") > 0.4).cast("int").alias("m"))
    out = C.repaired(px, mask, "v", 0.6, 0.3)
    return rounded(out.groupBy("clip", "f").agg(F.count_if("core").alias("core"), F.count_if(F.expr("core and was < 0.6")).alias("repaired"), F.count_if("severe").alias("severe"), F.sum("v").alias("mass")), "mass")


@query("c4_unmix", f"with {PX1}, l0 as (select *, avg(v) over (partition by clip, f, y order by x range between 1 preceding and 1 following) as row_mean from px), l as (select *, avg(row_mean) over (partition by clip, f, x order by y range between 1 preceding and 1 following) as loc from l0) select clip, f, y, x, round(least(1, greatest(0, 1 - v / greatest(loc, 1e-6))), 6) as coverage from l")
def _(spark, d):
    return rounded(C.unmixed(px1(spark, d), "v"), "coverage")


_RAMP = "pow(least(1, greatest(0, (bg_floor - score) / greatest(bg_floor - 0.025::double, 1e-6))), 1.22::double)"
_KEYED = f"""{PX4}, {_PROFILE}, al as (select px.*, key_r, key_g, key_b, case when bg_floor < 0.42 then 'fail' else 'ok' end as status, (case when {_RAMP} < 0.035 then 0 when {_RAMP} > 0.995 then 1 else {_RAMP} end)::double as alpha from px join prof using (clip)),
rec as (select clip, f, y, x, status, alpha, """ + ", ".join(
    f"{c} * (1 - least(1, greatest(0, 1.8::double * (1 - alpha)))) + least(1, greatest(0, ({c} - (1 - alpha) * key_{c}) / greatest(alpha, 0.055::double))) * least(1, greatest(0, 1.8::double * (1 - alpha))) as {c}" for c in "rgb"
) + " from al)"


def keyed(spark, d):
    px = px4(spark, d)
    return C.adaptive_key(px, P.clip_profile(px.drop("score"), edge4()))


@query("i6_adaptive_key", f"with {_KEYED} select clip, f, y, x, round(alpha, 6) as alpha, round(r, 6) as r, round(least(g, greatest(r, b) + 0.006::double), 6) as g, round(b, 6) as b from rec")
def _(spark, d):
    return rounded(keyed(spark, d).drop("status"), "alpha", "r", "g", "b")


@query("i7_clip_pipeline", f"""with {_KEYED}, n as (select clip, count(*)::int as n from frames group by clip), sm as (select a.clip, {_L1.format(a='a.e', b='b.e')} as s from frames a join n on n.clip = a.clip and a.f = 0 join frames b on b.clip = a.clip and b.f = n.n - 1),
v as (select clip, count(distinct f) as frames, avg((alpha > 0.05)::int) as visible, any_value(status) as profile from rec group by clip)
select clip, v.frames, round(visible, 6) as visible, case when profile = 'fail' or visible < 0.04 then 'fallback' else 'ok' end as status, case when s <= 0.012 then 'direct' else 'crossfade' end as closure from v join sm using (clip)""")
def _(spark, d):
    return rounded(C.clip_report(keyed(spark, d), C.seam(frames(spark, d))), "visible")
