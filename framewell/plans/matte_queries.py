"""Keying and the clip pipeline over scenes that the embeddings table gives: a row is a frame of 12 x 12 pixels.

A frame shows a subject before a screen, both shaded by the row's 64 numbers. The label says how the clip was shot: 1
hardly moves, 3 has a weak screen, 4 and 9 have no subject, 8 has a grey screen, the others are plain.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from framewell.functions import exprs as X
from framewell.functions import plugins
from framewell.operators import clip_pipeline as L
from framewell.operators import matte as M
from framewell.operators import providers as V
from framewell.plans.pixel_queries import A1, FRAMES, _A1, frames, rounded
from framewell.plans.registry import query

SIDE = 12
RULES = M.KeyRules(margin=1, band=2, window=5, despill_radius=2.0, support=2, gap_area=(1, 0.08))
MOTION = (0.02, 1)
LADDER = L.Ladder((0.02, 0.08, 0.12), 0.06)
LOOP = L.Loop(start_below=8, least=20)

SCENE = f"""{FRAMES}, p0 as (select clip, f, p, (p // 12)::int as y, (p % 12)::int as x, 64 - ((p // 12) * 2 // 3 * 8 + (p % 12) * 2 // 3) as k, e, case when clip = 1 then 0.02::double else 1 end as amp from frames, unnest(range(144)) t(p)),
p1 as (select *, 0.5::double + amp * (least(1, greatest(0, 0.5::double + 1.5::double * e[65 - k]::double)) - 0.5::double) as v, 0.5::double + amp * (least(1, greatest(0, 0.5::double + 1.5::double * e[k]::double)) - 0.5::double) as w, sqrt((y - 5.5::double) * (y - 5.5::double) + (x - 5.5::double) * (x - 5.5::double)) as d from p0),
p2 as (select *, (case when clip in (4, 9) then 0 when d < 2.6 and v < 0.12 then 0 when d > 4 and v > 0.86 then 0.9::double else least(1, greatest(0, (4.2::double - d) / 1.6::double + 0.6::double * (v - 0.5::double))) end)::double as c, (0.75::double + 0.4::double * (w - 0.5::double)) as l, 0.2::double * (w - 0.5::double) as s from p1),
px as (select clip, f, y, x, c * (0.62::double + s) + (1 - c) * (case when clip = 8 then 0.5::double when clip = 3 then 0.3::double else 0.10::double end * l) as r,
  c * (0.55::double + s + case when d > 2.5 then 0.06::double else 0 end) + (1 - c) * (case when clip = 8 then 0.5::double when clip = 3 then 0.5::double else 0.62::double end * l) as g,
  c * (0.42::double + s) + (1 - c) * (case when clip = 8 then 0.5::double when clip = 3 then 0.31::double else 0.12::double + 0.04::double * (v - 0.5::double) end * l) as b from p2),
sc as (select *, (g - greatest(r, b)) / greatest(g, 1.0::double / 255) as score from px)"""


def scene(spark, d):
    """(clip, f, height, width, r, g, b)."""
    clip = F.col("clip")
    amp = F.when(clip == 1, 0.02).otherwise(1.0)
    light, weak, grey = clip.isin(4, 9), clip == 3, clip == 8

    def shaded(k):
        return 0.5 + amp * (X.clamp(0.5 + 1.5 * F.element_at("e", k)) - 0.5)

    def at(p):
        y, x = F.floor(p / F.lit(SIDE)).cast("int"), p % SIDE
        k = (F.floor(y * 2 / F.lit(3)) * 8 + F.floor(x * 2 / F.lit(3))).cast("int")
        return F.struct(shaded(k + 1).alias("v"), shaded(64 - k).alias("w"), F.sqrt((y - 5.5) * (y - 5.5) + (x - 5.5) * (x - 5.5)).alias("d"))

    def cover(s):
        c = F.when(light, 0.0).when((s["d"] < 2.6) & (s["v"] < 0.12), 0.0).when((s["d"] > 4) & (s["v"] > 0.86), 0.9).otherwise(X.clamp((4.2 - s["d"]) / 1.6 + 0.6 * (s["v"] - 0.5)))
        return F.struct(c.alias("c"), (0.75 + 0.4 * (s["w"] - 0.5)).alias("l"), (0.2 * (s["w"] - 0.5)).alias("s"), s["d"].alias("d"), s["v"].alias("v"))

    def mixed(t, fur, screen):
        return t["c"] * fur + (1 - t["c"]) * (screen * t["l"])

    def colour(t):
        return F.struct(
            mixed(t, 0.62 + t["s"], F.when(grey, 0.5).when(weak, 0.3).otherwise(0.10)).alias("r"),
            mixed(t, 0.55 + t["s"] + F.when(t["d"] > 2.5, 0.06).otherwise(0.0), F.when(grey, 0.5).when(weak, 0.5).otherwise(0.62)).alias("g"),
            mixed(t, 0.42 + t["s"], F.when(grey, 0.5).when(weak, 0.31).otherwise(0.12 + 0.04 * (t["v"] - 0.5))).alias("b"),
        )

    def plane(c):
        return F.transform("px", lambda p: p[c]).alias(c)

    px = F.transform(F.transform(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), at), cover), colour)
    rows = frames(spark, d).select("clip", "f", px.alias("px"))
    return rows.select("clip", "f", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), *map(plane, M.PLANES))


def _flood(name: str, start: str, mask: str, extra: str = "") -> str:
    """{name}: pixels of `mask` that are reached from those of `start` over 8 neighbours; extra: a column that is handed on."""
    e, of = (f", {extra}", f", r.{extra}") if extra else ("", "")
    return f"""{name} as (select clip, f, y, x{e} from {start} union select m.clip, m.f, m.y, m.x{of} from {name} r join {mask} m on m.clip = r.clip and m.f = r.f and abs(m.y - r.y) <= 1 and abs(m.x - r.x) <= 1)"""


def _parts(name: str, mask: str) -> str:
    """{name}: pixels of `mask` with the label of their component."""
    return f"""{name}0 as (select clip, f, y, x, y * 12 + x as l from {mask}), {_flood(name + '1', name + '0', mask, 'l')}, {name} as (select clip, f, y, x, min(l) as label from {name}1 group by clip, f, y, x)"""


BAND = "(y < 2 or y >= 10 or x < 2 or x >= 10)"
PROFILE = f"""n as (select clip, count(*)::int as n from frames group by clip), band as (select sc.*, score > 0.30 and g > 0.14 as green from sc join n using (clip) where {BAND} and f % greatest(1, n // 12) = 0),
usable as (select clip, f from band group by clip, f having avg(green::int) >= 0.45),
prof as (select n.clip, case when count(score) > 0 then least(0.98, quantile_cont(score, 0.002)) end as bg_floor, median(r) as key_r, median(g) as key_g, median(b) as key_b, count(distinct f) as sampled_frames, (count(score) > 0 and least(0.98, quantile_cont(score, 0.002)) >= 0.42)::int as ok
  from n left join (select * from band join usable using (clip, f) where green) u on u.clip = n.clip group by n.clip)"""
MOVED = """mv0 as (select clip, f, y, x, greatest(coalesce(case when lag(f) over w = f - 1 then (abs(r - lag(r) over w) + abs(g - lag(g) over w) + abs(b - lag(b) over w)) / 3 end, 0), coalesce(case when lead(f) over w = f + 1 then (abs(r - lead(r) over w) + abs(g - lead(g) over w) + abs(b - lead(b) over w)) / 3 end, 0)) > 0.02 as m from px window w as (partition by clip, y, x order by f)),
mv1 as (select *, bool_or(m) over (partition by clip, f, y order by x range between 1 preceding and 1 following) as mx from mv0), mv as (select clip, f, y, x, bool_or(mx) over (partition by clip, f, x order by y range between 1 preceding and 1 following) as motion from mv1)"""


def _mean(c: str, n: int = 2) -> str:
    return f"avg({c}) over (partition by clip, f, {{}} order by {{}} range between {n} preceding and {n} following)"


# the keyed pixels: fin, of clips whose profile is ok
KEYED = f"""{PROFILE}, {MOVED},
base as materialized (select sc.*, bg_floor, key_r, key_g, key_b, least(0.025::double, bg_floor * 0.08::double) as fgs, motion from sc join prof using (clip) join mv using (clip, f, y, x) where ok = 1),
cand as (select * from base where score > fgs and g > 0.035), edge0 as (select * from cand where y in (0, 11) or x in (0, 11)), {_flood('rch', 'edge0', 'cand')},
inside as (select cand.* from cand anti join rch using (clip, f, y, x)), {_parts('ins', 'inside')},
gap as (select clip, f, label from ins join base using (clip, f, y, x) group by clip, f, label having count(*) <= 144 * 0.08 and avg(y) >= 12 * 0.40 and quantile_cont(score, 0.75) > 0.14),
bgd as (select clip, f, y, x from rch union select clip, f, y, x from ins join gap using (clip, f, label)),
k0 as (select base.*, bgd.clip is not null as rea from base left join bgd using (clip, f, y, x)), k1 as (select *, rea and score >= bg_floor as sure, greatest(0, g - greatest(r, b)) as exc from k0),
k2 as (select *, {_mean('sure::int').format('y', 'x')} as s1, {_mean('case when sure then exc else 0 end').format('y', 'x')} as e1 from k1), k3 as (select *, {_mean('s1').format('x', 'y')} as s2, {_mean('e1').format('x', 'y')} as e2 from k2),
k4 as (select *, 1 - least(1, greatest(0, exc / greatest(case when s2 > 0.02 then e2 / greatest(s2, 1e-4) else greatest(key_g - greatest(key_r, key_b), 0.10) end, 0.10))) as cov from k3),
k5 as (select *, case when rea then pow(least(1, greatest(0, (bg_floor - score) / greatest(bg_floor - fgs, 1e-4))), 1.22::double) else 1 end as ramp from k4),
k6 as (select *, case when motion and rea and score < bg_floor and cov > 0.05 then greatest(ramp, cov) else ramp end as a0 from k5),
k7 as (select *, (case when y in (0, 11) or x in (0, 11) or a0 < 0.035 then 0 when a0 > 0.995 then 1 else a0 end)::double as a1 from k6),
own as (select clip, f, count(*) filter (gr) as n, median(r) filter (gr) as r, median(g) filter (gr) as g, median(b) filter (gr) as b, count(*) as band from (select *, score > 0.30 and g > 0.14 as gr from base where {BAND}) group by clip, f),
k8 as materialized (select k7.*, case when o.n >= o.band * 0.30 then o.r else key_r end as kr, case when o.n >= o.band * 0.30 then o.g else key_g end as kg, case when o.n >= o.band * 0.30 then o.b else key_b end as kb, least(1, greatest(0, (1 - a1) * 1.8::double)) as wt,
  rea and a1 > 0.018 and a1 < 0.995 and score > fgs as edge, a1 > 0.985 and not rea as core from k7 join own o using (clip, f)),
k9 as (select *, {', '.join(f'{c} * (1 - wt) + least(1, greatest(0, ({c} - (1 - a1) * k{c}) / greatest(a1, 0.055::double))) * wt as c{c}' for c in 'rgb')} from k8),
nr as (select e.clip, e.f, e.y, e.x, arg_min({{'r': c.r, 'g': c.g, 'b': c.b}}, ((e.y - c.y) * (e.y - c.y) + (e.x - c.x) * (e.x - c.x)) * 10000 + c.y * 100 + c.x) as q from k8 e join k8 c on c.clip = e.clip and c.f = e.f and e.edge and c.core group by e.clip, e.f, e.y, e.x),
k10 as (select k9.*, least(1, greatest(0, (0.985::double - a1) / 0.72::double)) as pull, nr.q from k9 left join nr using (clip, f, y, x)),
k11 as (select * replace ({', '.join(f'case when q is null then c{c} else c{c} * (1 - pull) + q.{c} * pull end as c{c}' for c in 'rgb')}) from k10), k12 as (select * replace (case when edge then least(cg, greatest(cr, cb) + 0.006::double) else cg end as cg) from k11),
k13 as materialized (select *, a1 > 0.90 as solid, cg - (cr * 0.65::double + cb * 0.35::double) as bias, (cg - greatest(cr, cb)) / greatest(greatest(cr, cb), 0.08::double) as dom from k12),
spl as (select distinct s.clip, s.f, s.y, s.x, true as hit from k13 s join k13 o on o.clip = s.clip and o.f = s.f and s.solid and s.bias > 0.012 and s.dom < 0.12 and not o.solid and (s.y - o.y) * (s.y - o.y) + (s.x - o.x) * (s.x - o.x) <= 4),
k14 as (select k13.*, case when hit then least(bias, 0.18::double) * 1.10::double else 0 end as sp from k13 left join spl using (clip, f, y, x)),
k15 as (select clip, f, y, x, a1, cr + sp * 0.18::double as cr, cg - sp * 0.80::double as cg, cb + sp * 0.55::double as cb from k14),
vis as (select clip, f, y, x from k15 where a1 > 0.035), {_parts('vp', 'vis')}, sld as (select clip, f, y, x from k15 where a1 > 0.55), {_parts('sp', 'sld')},
body as (select clip, f, arg_max(label, (k, -label)) as label from (select clip, f, label, count(*) as k from sp group by all) group by clip, f),
arnd as (select distinct b.clip, b.f, b.y + i // 5 - 2 as y, b.x + i % 5 - 2 as x from (select sp.* from sp join body using (clip, f, label)) b, unnest(range(25)) t(i)),
keep as (select vp.clip, vp.f, vp.label from vp left join arnd using (clip, f, y, x) left join body on body.clip = vp.clip and body.f = vp.f group by vp.clip, vp.f, vp.label having count(*) >= 3 and (any_value(body.label) is null or count(arnd.clip) > 0)),
kpx as (select clip, f, y, x, true as kept from vp join keep using (clip, f, label)),
fin0 as (select k15.*, case when kept or a1 <= 0.035 then a1 else 0 end as alpha from k15 left join kpx using (clip, f, y, x)),
fin as materialized (select clip, f, y, x, alpha, {', '.join(f'case when alpha = 0 then 0 else least(1, greatest(0, c{c})) end as {c}' for c in 'rgb')} from fin0)"""


def keyed(spark, d):
    shots = scene(spark, d)
    return M.adaptive_matte(M.with_motion(shots, *MOTION), M.clip_profile(shots, band=RULES.band), RULES)


@query("i6_scene_profile", f"with {SCENE}, {PROFILE} select clip, round(bg_floor, 6) as bg_floor, round(key_r, 6) as key_r, round(key_g, 6) as key_g, round(key_b, 6) as key_b, sampled_frames, case when ok = 1 then 'ok' else 'fail' end as status from prof")
def _(spark, d):
    return rounded(M.clip_profile(scene(spark, d), band=RULES.band), "bg_floor", "key_r", "key_g", "key_b")


@query("i6_adaptive_matte", f"with recursive {SCENE}, {KEYED} select clip, f, (y * 12 + x)::int as pos, round(alpha, 6) as alpha, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b from fin")
def _(spark, d):
    rows = keyed(spark, d).where("status = 'ok'").select("clip", "f", F.posexplode(F.arrays_zip("alpha", *M.PLANES)).alias("pos", "v"))
    return rounded(rows.select("clip", "f", "pos", "v.*"), "alpha", *M.PLANES)


_DISTANCE = "list_sum(list_transform(range(1, 577), lambda i: abs({a}[i] - {b}[i]))) / 576"
_STEPS = ", ".join(f"({i + 1}, {s}::double)" for i, s in enumerate(LADDER.similarities))
_U, _V = "(-0.168736::double * {0}r - 0.331264::double * {0}g + 0.5::double * {0}b)", "(0.5::double * {0}r - 0.418688::double * {0}g - 0.081312::double * {0}b)"
_CHROMA = f"least(1, greatest(0, (sqrt((pow({_U.format('')} - {_U.format('k')}, 2) + pow({_V.format('')} - {_V.format('k')}, 2)) / 2) - similarity) / {LADDER.blend}::double))"
# attempts of each clip, the last of them, the frames it gives and their signatures
LADDERS = f"""pick as (select clip, n, greatest(1, n // 6) as step, least(6, ceil(n / greatest(1, n // 6))) // 2 as middle from n),
q0 as (select fin.*, f // step as place, middle, alpha > 16.0::double / 255 as seen from fin join pick using (clip) where f % step = 0 and f // step < 6),
q1 as (select *, bool_or(not seen) over (partition by clip, f, y order by x range between 2 preceding and 2 following) as nx from q0), q2 as (select *, bool_or(nx) over (partition by clip, f, x order by y range between 2 preceding and 2 following) as near from q1),
q3 as (select clip, place = any_value(middle) as mid, avg(seen::int) as visible, case when count(*) filter (seen) = 0 then 1 else count(*) filter (seen and g > r + 24.0::double / 255 and g > b + 24.0::double / 255 and (near or alpha < 245.0::double / 255))::double / count(*) filter (seen) end as residual from q2 group by clip, place),
first as (select n.clip, 0 as attempt, null::double as similarity, max(visible) filter (mid) as visible, max(residual) as residual from n left join q3 on q3.clip = n.clip group by n.clip),
kc as (select clip, coalesce(median(r) filter (sure), avg(r) filter (corner)) as kr, coalesce(median(g) filter (sure), avg(g) filter (corner)) as kg, coalesce(median(b) filter (sure), avg(b) filter (corner)) as kb
  from (select *, {BAND} and g > r + 30.0::double / 255 and g > b + 30.0::double / 255 and g > 120.0::double / 255 as sure, f = 0 and y between 4 and 11 and x between 4 and 11 as corner from px where f < 3) group by clip),
steps(attempt, similarity) as (values {_STEPS}),
c0 as (select px.clip, f, y, x, r, least(g, (r + b) / 2) as g2, b, attempt, similarity, {_CHROMA} as alpha, f // step as place, middle from px join kc using (clip) join pick using (clip) cross join steps where f % step = 0 and f // step < 6 and clip in (select clip from first where coalesce(visible < 0.04, true))),
c1 as (select clip, attempt, similarity, place = any_value(middle) as mid, avg((alpha > 16.0::double / 255)::int) as visible,
  case when count(*) filter (alpha > 16.0::double / 255) = 0 then 1 else count(*) filter (alpha > 16.0::double / 255 and g2 > r + 24.0::double / 255 and g2 > b + 24.0::double / 255)::double / count(*) filter (alpha > 16.0::double / 255) end as residual from c0 group by clip, attempt, similarity, place),
tried as (select * from first union all select clip, attempt, similarity, max(visible) filter (mid), max(residual) from c1 group by clip, attempt, similarity),
said as materialized (select *, case when attempt = 0 then case when visible >= 0.04 then 0 else 1 end when not coalesce(visible >= 0.04, false) then 2 when residual < 0.015 then 3 else 4 end as state from tried),
done as materialized (select clip, coalesce(min(attempt) filter (state in (0, 2, 3)), max(attempt)) as attempt from said group by clip), won as materialized (select said.* from said join done using (clip, attempt)),
fb as (select px.clip, f, y, x, {_CHROMA} as alpha, r, least(g, (r + b) / 2) as g, b from px join kc using (clip) join won using (clip) where state in (3, 4)),
chosen as (select fin.clip, f, y, x, alpha, r, g, b from fin join won using (clip) where state = 0 union all select * from fb),
sig as materialized (select clip, f, flatten(list([r * alpha, g * alpha, b * alpha, alpha] order by y, x)) as e from chosen group by clip, f)"""
# 1 optimised, 2 locked, 3 still, 0 plain
_KIND = "case when clip in (0, 1, 2) then 1 when clip = 5 then 2 when clip = 6 then 3 else 0 end"
LOOPS = f"""ends as (select clip, count(*)::int as frames, arg_min(e, f) as a, arg_max(e, f) as b, {_KIND} as kind from sig group by clip), seams as materialized (select clip, frames, kind, {_DISTANCE.format(a='a', b='b')} as seam from ends),
pairs as (select a.clip, a.f as start, b.f as "end", frames, {_DISTANCE.format(a='a.e', b='b.e')} as diff from sig a join sig b on a.clip = b.clip and a.f <= 8 and b.f >= a.f + 20 join seams on seams.clip = a.clip where kind = 1 and frames >= 22 and a.f <= frames - 21),
best as materialized (select clip, arg_min({{'s': start, 'e': "end", 'd': diff}}, (round(diff + 0.000025::double * (frames - "end") + 0.00004::double * start, 9), start, "end")) as p from pairs group by clip),
l0 as materialized (select seams.*, p, kind = 2 and frames >= 2 as locked, p is not null as spanned, coalesce(p.d <= 0.012, false) as direct, case when p is not null then p.e - p.s + 1 else frames end as selected, case when kind <> 1 then null when frames < 22 then 1 when p is null then 2 else 3 end as span_mode from seams left join best using (clip)),
l1 as (select *, case when selected - 2 * least(6, selected // 5) >= 24 then selected - 2 * least(6, selected // 5) else selected end as trimmed from l0), l2 as (select *, case when locked or direct or selected < 2 or kind = 3 then 0 else least(8, trimmed // 5) end as closed from l1),
lp as materialized (select clip, case when locked then 4 else coalesce(span_mode, 0) end as mode_, case when spanned and not locked then p.d else seam end as seam, case when locked then 1 when direct then 2 when closed > 0 then 3 else 0 end as closure_, p.s as start, p.e as "end", closed::int as closed,
  case when locked or selected < 2 then frames when direct then selected else trimmed - closed end::int as out_frames from l2)"""


def _hex(r: str, g: str, b: str) -> str:
    return "printf('0x%02X%02X%02X', " + ", ".join(f"floor({c} * 255 + 0.5)::int" for c in (r, g, b)) + ")"


@query("i7_quality_ladder", f"with recursive {SCENE}, {KEYED}, {LADDERS} select clip, attempt, similarity, round(visible, 6) as visible, round(residual, 6) as residual from tried")
def _(spark, d):
    shots = scene(spark, d)
    tried = L.attempts(M.with_motion(shots, *MOTION), M.clip_profile(shots, band=RULES.band), RULES, LADDER, band=RULES.band)
    return rounded(tried, "visible", "residual")


@query("i7_clip_metrics", f"""with recursive {SCENE}, {KEYED}, {LADDERS}, {LOOPS}
select clip, ['ok', 'next', 'failed', 'fallback', 'review'][state + 1] as status, attempt, similarity, round(visible, 6) as visible, round(residual, 6) as residual, round(bg_floor, 6) as bg_floor, case when state = 0 then {_hex('key_r', 'key_g', 'key_b')} else {_hex('kr', 'kg', 'kb')} end as key_colour,
  n as frames, ['plain', 'too_short', 'not_found', 'best_span', 'locked_endpoints'][mode_ + 1] as mode, round(seam, 6) as seam, ['none', 'locked', 'direct', 'crossfade'][closure_ + 1] as closure, start::double as start, "end"::double as "end", closed, out_frames from won join n using (clip) join prof using (clip) join kc using (clip) left join lp using (clip)""")
def _(spark, d):
    clip = F.col("clip")
    kind = F.when(clip.isin(0, 1, 2), "optimised").when(clip == 5, "locked").when(clip == 6, "still").otherwise("plain")
    kinds = frames(spark, d).select("clip").distinct().withColumn("kind", kind)
    out = L.clip_pipeline(scene(spark, d), kinds, RULES, LADDER, LOOP, MOTION, band=RULES.band)
    return rounded(out.withColumns({c: F.col(c).cast("double") for c in ("start", "end")}), "visible", "residual", "bg_floor", "seam")


plugins.register_provider("scene_key", V.adaptive_key(RULES, *MOTION))
# frames as image bytes, and what the provider gives as bytes again
_BYTES = SCENE.replace("px as (select", "px00 as (select").replace("sc as (select", "px as (select clip, f, y, x, " + ", ".join(f"floor({c} * 255 + 0.5) / 255.0::double as {c}" for c in "rgb") + " from px00),\nsc as (select")
_OUT = ", ".join(f"floor(round({c} * 255, 6) + 0.5) / 255.0::double as {n}" for n, c in (("a", "alpha"), ("out_r", "r"), ("out_g", "g"), ("out_b", "b")))


@query("u1_provider_metrics", f"""with recursive {_BYTES}, {KEYED}, outp as (select clip, f, y, x, {_OUT} from fin), cnd as (select clip, f, y, x from sc where score > 0.32 and g > 0.18), cnde as (select * from cnd where y in (0, 11) or x in (0, 11)), {_flood('rb', 'cnde', 'cnd')},
m0 as (select sc.clip, sc.f, sc.y, sc.x, sc.g, score, a, out_r, out_g, out_b, rb.clip is not null and score > 0.42 as bg, score < 0.025 or sc.g < 0.10 as fg from sc join outp using (clip, f, y, x) left join rb using (clip, f, y, x)),
m1 as (select clip, f, {_A1.replace('g - (r + b) * 0.5::double', 'out_g - (out_r + out_b) * 0.5::double')}, avg(a) as mean_alpha from m0 group by clip, f), shown as (select clip, f, y, x from m0 where a > 0.08), {_parts('shp', 'shown')},
ar as (select clip, f, label, count(*) as area from shp group by clip, f, label), fr as (select clip, f, (sum(area) - max(area)) * 100.0::double / sum(area) as fragment_pct, (count(*) filter (area >= 4) - 1)::double as fragment_count from ar group by clip, f)
select clip, printf('f_%04d', f) as name, {', '.join(f'round(coalesce({c}, 0), 5) as {c}' for c in A1)}, round(mean_alpha, 5) as mean_alpha from m1 left join fr using (clip, f)""")
def _(spark, d):
    def byte(p):
        return F.concat(*[F.lpad(F.hex(F.floor(p[c] * 255 + 0.5).cast("int")), 2, "0") for c in "bgr"])

    # providers go by the order of names, which four digits keep for 10000 frames only
    shots = scene(spark, d).select(F.col("clip").cast("string").alias("clip"), F.format_string("f_%010d", "f").alias("name"), "width", "height", F.lit(3).alias("n_channels"), F.unhex(F.array_join(F.transform(F.arrays_zip(*M.PLANES), byte), "")).alias("data"))
    metrics, _ = V.evaluated(shots, "scene_key", SIDE, SIDE)
    name = F.format_string("f_%04d", F.substring("name", 3, 10).cast("int"))
    return rounded(metrics.withColumns({"clip": F.col("clip").cast("long"), "name": name}).select("clip", "name", *A1, "mean_alpha"), *A1, "mean_alpha", places=5)
