"""Pixel operators over the embeddings table: a row is a frame, its label the clip.

PX1 takes the 64 numbers as an 8 x 8 plane, PX4 as 4 x 4 pixels of four channels.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions import exprs as X
from framewell.operators import pixels as P
from framewell.plans.registry import query, table

FRAMES = "frames as (select vec_id, label as clip, (row_number() over (partition by label order by vec_id) - 1)::int as f, embedding as e from embeddings)"
PX1 = f"{FRAMES}, px as (select clip, f, (p // 8)::int as y, (p % 8)::int as x, least(1, greatest(0, 1.5::double * e[p + 1]::double + 0.5::double)) as v from frames, unnest(range(64)) t(p))"
_CH = "least(1, greatest(0, 1.5::double * e[4 * p + {}]::double + 0.5::double))"
PX4 = f"""{FRAMES}, px0 as (select clip, f, (p // 4)::int as y, (p % 4)::int as x, {_CH.format(1)} as r, {_CH.format(2)} as g, {_CH.format(3)} as b, least(1, greatest(0, 3::double * e[4 * p + 4]::double + 0.5::double)) as a
  from frames, unnest(range(16)) t(p)),
px as (select *, (g - greatest(r, b)) / greatest(g, 1.0::double / 255) as score, ((g - greatest(r, b)) / greatest(g, 1.0::double / 255)) > 0.42 as bg,
  ((g - greatest(r, b)) / greatest(g, 1.0::double / 255)) < 0.025 or g < 0.10 as fg from px0)"""
_JOINED = "{t}.clip = cc{n}.clip and {t}.f = cc{n}.f and abs({t}.y - cc{n}.y) <= 1 and abs({t}.x - cc{n}.x) <= 1"


def _labels(t: str, n: str, width: int = 4) -> str:
    """lab{n}: labels of the pixels in t."""
    return f"""cc{n} as (select clip, f, y, x, y * {width} + x as l from {t} union select {t}.clip, {t}.f, {t}.y, {t}.x, cc{n}.l from cc{n} join {t} on {_JOINED.format(t=t, n=n)}),
lab{n} as (select clip, f, y, x, min(l)::bigint as label from cc{n} group by clip, f, y, x)"""


#: Background that is reached from the border: pc is px with reached and bg of it.
REACHED = f"""cand as (select clip, f, y, x from px where score > 0.32 and g > 0.18), {_labels('cand', 'b')}, touch as (select distinct clip, f, label from labb where x in (0, 3) or y in (0, 3)),
rc as (select labb.*, true as hit from labb join touch using (clip, f, label)), pc as (select px.* exclude (bg), rc.hit is not null as reached, rc.hit is not null and score > 0.42 as bg from px left join rc using (clip, f, y, x))"""
EDGE4 = "(y in (0, 3) or x in (0, 3))"


def frames(spark, d):
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("clip"), n.alias("f"), e.alias("e"))


def px1(spark, d):
    plane = F.transform("e", lambda v: X.clamp(1.5 * v + 0.5))
    return P.pixels_of(frames(spark, d).select("clip", "f", plane.alias("v")), ["v"], 8)


def px4(spark, d):
    def channel(c: int, gain: float):
        return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: X.clamp(gain * F.element_at("e", 4 * p + (c + 1)) + 0.5))

    planes = [channel(0, 1.5).alias("r"), channel(1, 1.5).alias("g"), channel(2, 1.5).alias("b"), channel(3, 3.0).alias("a")]
    return P.regions(P.pixels_of(frames(spark, d).select("clip", "f", *planes), ["r", "g", "b", "a"], 4))


def edge4():
    return F.col("y").isin(0, 3) | F.col("x").isin(0, 3)


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("s7_pixels", f"with {PX1} select clip, f, y, x, round(v, 6) as v from px")
def _(spark, d):
    return rounded(px1(spark, d), "v")


@query("s10_manifest", f"with {FRAMES} select clip, count(*) as frames, printf('%s__f_%04d.png', clip::varchar, max(f)) as last_name from frames group by clip")
def _(spark, d):
    return frames(spark, d).groupBy("clip").agg(F.count("*").alias("frames"), F.format_string("%s__f_%04d.png", F.col("clip").cast("string"), F.max("f")).alias("last_name"))


@query("s15_inventory", "select label as clip, count(*) as frames, count(distinct len(embedding)) as sizes, count(distinct len(embedding)) > 1 as mixed from embeddings group by label")
def _(spark, d):
    n = F.count_distinct(F.size("embedding"))
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("clip")).agg(F.count("*").alias("frames"), n.alias("sizes"), (n > 1).alias("mixed"))


@query("c1_dominance", f"with {PX4} select clip, f, y, x, round(score, 6) as score, bg, fg from px")
def _(spark, d):
    return rounded(px4(spark, d).select("clip", "f", "y", "x", "score", "bg", "fg"), "score")


@query("c2_colour", f"""with {PX4} select clip, f, y, x, round(0.299::double * r + 0.587::double * g + 0.114::double * b, 6) as luma601, round(0.2126::double * r + 0.7152::double * g + 0.0722::double * b, 6) as luma709,
  round(greatest(r, g, b) - least(r, g, b), 6) as chroma, round(r - b, 6) as warmth, round(g - (r + b) / 2, 6) as green_bias from px""")
def _(spark, d):
    r, g, b = (F.col(c) for c in "rgb")
    out = px4(spark, d).select("clip", "f", "y", "x", X.luma601(r, g, b).alias("luma601"), X.luma709(r, g, b).alias("luma709"), X.chroma_range(r, g, b).alias("chroma"), (r - b).alias("warmth"), (g - (r + b) / 2).alias("green_bias"))
    return rounded(out, "luma601", "luma709", "chroma", "warmth", "green_bias")


_RAMP = "pow(least(1, greatest(0, (0.42::double - score) / (0.42::double - 0.025::double))), 1.22::double)"


@query("c3_key_ramp", f"with {PX4} select clip, f, y, x, round(case when {_RAMP} < 0.035 then 0 when {_RAMP} > 0.995 then 1 else {_RAMP} end, 6) as alpha from px")
def _(spark, d):
    return rounded(px4(spark, d).select("clip", "f", "y", "x", X.key_ramp(F.col("score"), F.lit(0.42)).alias("alpha")), "alpha")


@query("c5_recovery", f"""with {PX4}, w as (select *, least(1, greatest(0, 1.8::double * (1 - a))) as w, least(1, greatest(0, (g - (1 - a) * 0.9::double) / greatest(a, 0.055::double))) as clean from px)
select clip, f, y, x, round(g * (1 - w) + clean * w, 6) as g from w""")
def _(spark, d):
    return rounded(px4(spark, d).select("clip", "f", "y", "x", X.recover(F.col("g"), F.col("a"), F.lit(0.9)).alias("g")), "g")


@query("c6_spill_cap", f"with {PX4} select clip, f, y, x, round(least(g, greatest(r, b) + 0.006::double), 6) as g from px")
def _(spark, d):
    return rounded(px4(spark, d).select("clip", "f", "y", "x", X.spill_cap(F.col("r"), F.col("g"), F.col("b")).alias("g")), "g")


_ODDS = "case when a <= 0 then 0 when a >= 1 then 1 else pow(a / (1 - a), 1.3::double) / (1 + pow(a / (1 - a), 1.3::double)) end"


@query("c7_contrast", f"with {PX4} select clip, f, y, x, round({_ODDS}, 6) as a from px")
def _(spark, d):
    return rounded(px4(spark, d).select("clip", "f", "y", "x", X.odds_contrast(F.col("a"), 1.3).alias("a")), "a")


@query("c8_trimap", f"with {PX4} select clip, f, y, x, case when bg then 0 when fg and a > 0.9 then 255 else 128 end as trimap, round(least(a + 0.1::double, greatest(a - 0.1::double, r)), 6) as fused from px")
def _(spark, d):
    a = F.col("a")
    out = px4(spark, d).select("clip", "f", "y", "x", F.when(F.col("bg"), 0).when(F.col("fg") & (a > 0.9), 255).otherwise(128).alias("trimap"), F.least(a + 0.1, F.greatest(a - 0.1, F.col("r"))).alias("fused"))
    return rounded(out, "fused")


@query("c9_over_grey", f"with {PX4} select clip, f, y, x, round(r * a + 0.5::double * (1 - a), 6) as r, round(g * a + 0.5::double * (1 - a), 6) as g, round(b * a + 0.5::double * (1 - a), 6) as b from px")
def _(spark, d):
    a = F.col("a")
    return rounded(px4(spark, d).select("clip", "f", "y", "x", *[X.over_grey(F.col(c), a).alias(c) for c in "rgb"]), "r", "g", "b")


@query("c10_quantise", f"with {PX4} select clip, f, y, x, floor(a * 255 + 0.5)::bigint as q, round_even(a * 255, 0)::bigint as q_even from px")
def _(spark, d):
    return px4(spark, d).select("clip", "f", "y", "x", X.quantise(F.col("a")).alias("q"), X.quantise_even(F.col("a")).alias("q_even"))


@query("p18_key_colour", f"""with {PX4}, m as (select clip, median(r) as r, median(g) as g, median(b) as b from px where {EDGE4} and score > 0.1 group by clip)
select clip, printf('0x%02X%02X%02X', floor(r * 255 + 0.5)::int, floor(g * 255 + 0.5)::int, floor(b * 255 + 0.5)::int) as colour from m""")
def _(spark, d):
    m = px4(spark, d).where(edge4() & (F.col("score") > 0.1)).groupBy("clip").agg(*[F.median(c).alias(c) for c in "rgb"])
    return m.select("clip", X.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))


@query("p20_mask_algebra", f"with {PX4} select clip, f, count(*) filter (fg and a > 0.5 and not bg) as core, count(*) filter (bg or a < 0.02) as outside, count(*) filter (fg and bg) as contradiction from px group by clip, f")
def _(spark, d):
    fg, bg, a = F.col("fg"), F.col("bg"), F.col("a")
    return px4(spark, d).groupBy("clip", "f").agg(F.count_if(fg & (a > 0.5) & ~bg).alias("core"), F.count_if(bg | (a < 0.02)).alias("outside"), F.count_if(fg & bg).alias("contradiction"))


_A1 = """(coalesce(avg(a) filter (bg), 1) + coalesce(avg(1 - a) filter (fg), 1)) * 0.5::double as pseudo_mae, coalesce(avg(a) filter (bg), 1) as background_alpha_mean, coalesce(avg(1 - a) filter (fg), 1) as foreground_loss_mean,
  coalesce(avg(greatest(0, g - (r + b) * 0.5::double) * a) filter (a > 0.02 and a < 0.98), 0) as green_fringe, avg((a > 0.50 and score > 0.25)::int) * 100 as opaque_green_leak_pct, avg((a > 0.02 and a < 0.98)::int) * 100 as soft_alpha_pct, avg((a > 0.02)::int) * 100 as coverage_pct"""
A1 = ["pseudo_mae", "background_alpha_mean", "foreground_loss_mean", "green_fringe", "opaque_green_leak_pct", "soft_alpha_pct", "coverage_pct", "fragment_pct", "fragment_count"]
_R = ", ".join(f"round({c}, 6) as {c}" for c in A1)
_FRAG = f"""vis as (select clip, f, y, x from px where a > 0.08), {_labels('vis', 'v')}, areas as (select clip, f, label, count(*) as area from labv group by all),
frag as (select clip, f, (sum(area) - max(area)) * 100.0::double / sum(area) as fragment_pct, (count(*) filter (area >= 4) - 1)::double as fragment_count from areas group by clip, f)"""
_M = f"{REACHED}, {_FRAG}, m0 as (select clip, f, {_A1} from pc group by clip, f), m as (select m0.*, coalesce(fragment_pct, 0) as fragment_pct, coalesce(fragment_count, 0) as fragment_count from m0 left join frag using (clip, f))"


def measured(px):
    """The nine metrics of frames whose output has the source's colours."""
    return P.frame_metrics(P.confident(px.drop("score"), 4, 4).withColumns({f"out_{c}": F.col(c) for c in "rgb"}), 4)


@query("a1_frame_metrics", f"with recursive {PX4}, {_M} select clip, f, {_R} from m")
def _(spark, d):
    return rounded(measured(px4(spark, d)), *A1)


@query("a2_clip_means", f"with recursive {PX4}, {_M} select clip, {', '.join(f'round(avg({c}), 6) as {c}' for c in A1)} from m group by clip")
def _(spark, d):
    return rounded(measured(px4(spark, d)).groupBy("clip").agg(*[F.avg(c).alias(c) for c in A1]), *A1)


_TEMP = "t as (select clip, f, avg(abs(a - prev)) as err from (select *, lag(a) over (partition by clip, y, x order by f) as prev from px) where prev is not null and (a > 0.02 or prev > 0.02) group by clip, f)"


def temporal(px):
    px = P.consecutive(px, "a").where("prev is not null and (a > 0.02 or prev > 0.02)")
    return px.groupBy("clip", "f").agg(F.avg(F.abs(F.col("a") - F.col("prev"))).alias("err"))


@query("i8_temporal_alpha_static", f"with {PX4}, {_TEMP} select clip, round(avg(err), 6) as temporal_alpha_mae_static from t group by clip")
def _(spark, d):
    return rounded(temporal(px4(spark, d)).groupBy("clip").agg(F.avg("err").alias("temporal_alpha_mae_static")), "temporal_alpha_mae_static")


#: Every tenth output is missing; providers report a runtime, the last one none.
_PAIRED = PX4.replace("px as (select *,", "px as (select px0.*,").replace("from px0)", "from px0 where f % 10 <> 9)")


@query("i9_provider_evaluation", f"""with recursive {_PAIRED}, {_M}, {_TEMP}, tt as (select clip, avg(err) as e from t group by clip), src as (select clip, count(*) as n, max(clip) over () as last from frames group by clip)
select m.clip as provider, count(*) as frames, any_value(n) - count(*) as missing, {', '.join(f'round(avg({c}), 6) as {c}' for c in A1)}, round(any_value(e), 6) as temporal_alpha_mae, case when m.clip < any_value(last) then m.clip * 1.5::double end as frame_ms from m join tt using (clip) join src using (clip) group by m.clip""")
def _(spark, d):
    source = px4(spark, d)
    names = frames(spark, d).select("clip", "f")
    outputs = names.where("f % 10 <> 9")
    paired = source.join(outputs, ["clip", "f"], "left_semi")
    missing = names.join(outputs, ["clip", "f"], "left_anti").groupBy("clip").agg(F.count("*").alias("missing"))
    clips = table(spark, d, "embeddings").select(F.col("label").alias("clip")).distinct()
    runtime = clips.join(F.broadcast(clips.agg(F.max("clip").alias("last"))), F.expr("clip < last")).select("clip", (F.col("clip") * 1.5).alias("frame_ms"))
    means = measured(paired).groupBy("clip").agg(F.count("*").alias("frames"), *[F.avg(c).alias(c) for c in A1])
    t = temporal(paired).groupBy("clip").agg(F.avg("err").alias("temporal_alpha_mae"))
    out = means.join(t, "clip").join(missing, "clip", "left").withColumn("missing", F.coalesce("missing", F.lit(0))).join(runtime, "clip", "left")
    return rounded(out.withColumnRenamed("clip", "provider"), *A1, "temporal_alpha_mae")


@query("a10_background_uniformity", f"""with recursive {PX4}, {REACHED} select clip, f, round(avg(reached::int) * 100, 6) as coverage_pct, round(coalesce((stddev_pop(r) filter (reached) + stddev_pop(g) filter (reached) + stddev_pop(b) filter (reached)) / 3, 1), 6) as rgb_std,
  round(coalesce(stddev_pop(score) filter (reached), 1), 6) as green_score_std, round(quantile_cont(score, 0.05) filter (reached), 6) as green_score_p05 from pc group by clip, f""")
def _(spark, d):
    reached = F.col("reached")

    def std(c: str):
        return F.stddev_pop(F.when(reached, F.col(c)))

    out = P.confident(px4(spark, d).drop("score"), 4, 4).groupBy("clip", "f").agg(
        (X.share(reached) * 100).alias("coverage_pct"), F.coalesce((std("r") + std("g") + std("b")) / 3, F.lit(1.0)).alias("rgb_std"),
        F.coalesce(std("score"), F.lit(1.0)).alias("green_score_std"), F.percentile(F.when(reached, F.col("score")), F.lit(0.05)).alias("green_score_p05"),
    )
    return rounded(out, "coverage_pct", "rgb_std", "green_score_std", "green_score_p05")


_PROFILE = f"""ok as (select clip, f from px where {EDGE4} group by clip, f having avg((score > 0.10)::int) >= 0.45),
prof as (select clip, least(0.98, quantile_cont(score, 0.002)) as bg_floor, median(r) as key_r, median(g) as key_g, median(b) as key_b, count(distinct f) as sampled_frames from px join ok using (clip, f) where {EDGE4} group by clip)"""


@query("a12_clip_profile", f"with {PX4}, {_PROFILE} select clip, round(bg_floor, 6) as bg_floor, round(key_r, 6) as key_r, round(key_g, 6) as key_g, round(key_b, 6) as key_b, sampled_frames, case when bg_floor < 0.42 then 'fail' else 'ok' end as status from prof")
def _(spark, d):
    return rounded(P.clip_profile(px4(spark, d).drop("score"), edge4()), "bg_floor", "key_r", "key_g", "key_b")


@query("a13_key_estimate", f"""with {PX4} select clip, round(coalesce(median(g) filter (score > 0.3), avg(g) filter (y in (0, 3) and x in (0, 3))), 6) as key_g, count(*) filter (score > 0.3) as confident from px where f < 12 and {EDGE4} group by clip""")
def _(spark, d):
    sure = F.col("score") > 0.3
    corner = F.col("y").isin(0, 3) & F.col("x").isin(0, 3)
    out = px4(spark, d).where(edge4() & (F.col("f") < 12)).groupBy("clip").agg(F.coalesce(F.median(F.when(sure, F.col("g"))), F.avg(F.when(corner, F.col("g")))).alias("key_g"), F.count_if(sure).alias("confident"))
    return rounded(out, "key_g")


@query("a14_matte_qa", f"""with {PX4}, n as (select clip, count(distinct f) as n from px group by clip), s as (select px.*, f // greatest(1, n // 6) as i, a > 16.0::double / 255 as seen from px join n using (clip) where f % greatest(1, n // 6) = 0 and f // greatest(1, n // 6) < 6),
er as (select *, bool_and(bool_and_x) over (partition by clip, f, x order by y range between 2 preceding and 2 following) as core from (select *, bool_and(seen) over (partition by clip, f, y order by x range between 2 preceding and 2 following) as bool_and_x from s)),
q as (select clip, i, case when count(*) filter (seen) = 0 then 1.0::double else count(*) filter (((seen and not core) or (seen and a < 245.0::double / 255)) and g > r + 24.0::double / 255 and g > b + 24.0::double / 255)::double / count(*) filter (seen) end as residual, avg(seen::int) as visible from er group by clip, i),
k as (select clip, count(*) as k from q group by clip)
select clip, round(max(residual), 6) as residual, round(max(visible) filter (i = k // 2), 6) as mid_visible, any_value(k) as sampled from q join k using (clip) group by clip""")
def _(spark, d):
    return rounded(P.matte_qa(px4(spark, d)), "residual", "mid_visible")


_BOX = "bx as (select clip, f, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from px where v > 0.7 group by clip, f)"


@query("a15_subject_box", f"with {PX1}, {_BOX} select *, least(x0, y0, 8 - x1, 8 - y1) as margin, least(x0, y0, 8 - x1, 8 - y1) >= 1 as safe from bx")
def _(spark, d):
    margin = F.least("x0", "y0", 8 - F.col("x1"), 8 - F.col("y1"))
    return P.box(px1(spark, d), F.col("v") > 0.7).withColumn("margin", margin).withColumn("safe", margin >= 1)


@query("c12_layout", f"""with {PX1}, {_BOX}, u as (select *, greatest(1, 0.045::double * greatest(x1 - x0, y1 - y0)) as pad from bx)
select clip, f, round(least(6.0::double / (x1 - x0 + 2 * pad), 6.0::double / (y1 - y0 + 2 * pad)), 6) as scale, round_even((8 - (x1 - x0)) / 2.0, 0)::int as px, (8 - (y1 - y0))::int as py from u""")
def _(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pad = F.greatest(F.lit(1.0), 0.045 * F.greatest(w, h))
    out = P.box(px1(spark, d), F.col("v") > 0.7).select("clip", "f", F.least(6.0 / (w + 2 * pad), 6.0 / (h + 2 * pad)).alias("scale"), F.rint((8 - w) / F.lit(2.0)).cast("int").alias("px"), (8 - h).cast("int").alias("py"))
    return rounded(out, "scale")


@query("c13_regions_of_interest", f"with {PX1}, {_BOX} select clip, f, x0 as head_x0, y0 as head_y0, x1 as head_x1, (y0 + trunc((y1 - y0) * 0.45::double))::int as head_y1, (y0 + trunc((y1 - y0) * 0.55::double))::int as lower_y0 from bx")
def _(spark, d):
    h = F.col("y1") - F.col("y0")
    return P.box(px1(spark, d), F.col("v") > 0.7).select("clip", "f", F.col("x0").alias("head_x0"), F.col("y0").alias("head_y0"), F.col("x1").alias("head_x1"), (F.col("y0") + (h * 0.45).cast("int")).alias("head_y1"), (F.col("y0") + (h * 0.55).cast("int")).alias("lower_y0"))


@query("c14_quadrants", f"with {PX1} select clip, f, (case when y < 4 then 0 else 2 end + case when x < 4 then 0 else 1 end)::int as quadrant, round(sum(v), 6) as mass, max(y % 4) as last_y from px group by all")
def _(spark, d):
    q = F.when(F.col("y") < 4, 0).otherwise(2) + F.when(F.col("x") < 4, 0).otherwise(1)
    return rounded(px1(spark, d).groupBy("clip", "f", q.alias("quadrant")).agg(F.sum("v").alias("mass"), F.max(F.col("y") % 4).alias("last_y")), "mass")


@query("a16_alpha_summary", f"with {PX4} select clip, f, round(min(a), 6) as lo, round(max(a), 6) as hi, round(avg((a <= 0)::int), 6) as zero, round(avg((a >= 1)::int), 6) as opaque, round(avg((a > 0 and a < 1)::int), 6) as part from px group by clip, f")
def _(spark, d):
    a = F.col("a")
    return rounded(px4(spark, d).groupBy("clip", "f").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), X.share(a <= 0).alias("zero"), X.share(a >= 1).alias("opaque"), X.share((a > 0) & (a < 1)).alias("part")), "lo", "hi", "zero", "opaque", "part")


@query("a20_contrast_stats", f"""with {PX4}, c as (select clip, f, round_even(a * 255, 0) as q0, round_even(({_ODDS}) * 255, 0) as q from px)
select clip, count(*) filter (q <> q0) as changed, round(coalesce(sum(abs(q - q0)) filter (q <> q0), 0) / greatest(count(*) filter (q <> q0), 1), 6) as mean_delta from c group by clip""")
def _(spark, d):
    c = px4(spark, d).select("clip", X.quantise_even(F.col("a")).alias("q0"), X.quantise_even(X.odds_contrast(F.col("a"), 1.3)).alias("q"))
    moved = F.col("q") != F.col("q0")
    out = c.groupBy("clip").agg(F.count_if(moved).alias("changed"), F.coalesce(F.sum(F.when(moved, F.abs(F.col("q") - F.col("q0")))), F.lit(0)).alias("s"))
    return rounded(out.select("clip", "changed", (F.col("s") / F.greatest("changed", F.lit(1))).alias("mean_delta")), "mean_delta")


@query("a21_trimap_share", f"with {PX4} select clip, f, round(avg(bg::int) * 100, 6) as background, round(avg((not bg and not (fg and a > 0.9))::int) * 100, 6) as unknown, round(avg((not bg and fg and a > 0.9)::int) * 100, 6) as foreground from px group by clip, f")
def _(spark, d):
    bg, fore = F.col("bg"), ~F.col("bg") & F.col("fg") & (F.col("a") > 0.9)
    return rounded(px4(spark, d).groupBy("clip", "f").agg((X.share(bg) * 100).alias("background"), (X.share(~bg & ~fore) * 100).alias("unknown"), (X.share(fore) * 100).alias("foreground")), "background", "unknown", "foreground")


@query("a22_fusion_delta", f"with {PX4} select clip, f, round(coalesce(avg(abs(least(a + 0.1::double, greatest(a - 0.1::double, r)) - a)) filter (not bg and not fg), 0), 6) as mean_delta from px group by clip, f")
def _(spark, d):
    a = F.col("a")
    delta = F.abs(F.least(a + 0.1, F.greatest(a - 0.1, F.col("r"))) - a)
    return rounded(px4(spark, d).groupBy("clip", "f").agg(X.avg_where(delta, ~F.col("bg") & ~F.col("fg"), 0.0).alias("mean_delta")), "mean_delta")


@query("a7_alpha_diagnostics", f"""with {PX1}, fr as (select clip, f, avg((v > 0.5)::int) as cov, avg((v > 0.02 and v < 0.98)::int) as soft, avg(abs(v - prev)) as mae, max((v > 0.5 and (x in (0, 7) or y in (0, 7)))::int) as edge
  from (select *, lag(v) over (partition by clip, y, x order by f) as prev from px) group by clip, f)
select clip, round(avg(cov), 6) as coverage, round(stddev_pop(cov) / nullif(avg(cov), 0), 6) as coverage_cv, round(min(cov), 6) as lo, round(max(cov), 6) as hi, round(avg(soft), 6) as soft,
  round(avg(mae), 6) as step_mae, round(quantile_cont(mae, 0.95), 6) as step_p95, sum(edge)::bigint as edge_frames, count(*) filter (cov = 0) as empty_frames from fr group by clip""")
def _(spark, d):
    v = F.col("v")
    edge = F.col("x").isin(0, 7) | F.col("y").isin(0, 7)
    fr = P.consecutive(px1(spark, d), "v").groupBy("clip", "f").agg(X.share(v > 0.5).alias("cov"), X.share((v > 0.02) & (v < 0.98)).alias("soft"), F.avg(F.abs(v - F.col("prev"))).alias("mae"), F.max(((v > 0.5) & edge).cast("int")).alias("edge"))
    out = fr.groupBy("clip").agg(
        F.avg("cov").alias("coverage"), X.ratio(F.stddev_pop("cov"), F.avg("cov")).alias("coverage_cv"), F.min("cov").alias("lo"), F.max("cov").alias("hi"), F.avg("soft").alias("soft"),
        F.avg("mae").alias("step_mae"), F.percentile("mae", F.lit(0.95)).alias("step_p95"), F.sum("edge").alias("edge_frames"), F.count_if(F.col("cov") == 0).alias("empty_frames"),
    )
    return rounded(out, "coverage", "coverage_cv", "lo", "hi", "soft", "step_mae", "step_p95")


@query("a8_mask_tracking", f"""with {PX1}, m as (select *, v > 0.5 as m, lag(v > 0.5) over (partition by clip, y, x order by f) as p, first_value(v > 0.5) over (partition by clip, y, x order by f) as r0 from px),
fr as (select clip, f, avg(m::int) as cov, case when f > 0 then coalesce(sum((m and p)::int)::double / nullif(sum((m or p)::int), 0), 1) end as iou, coalesce(sum((m and r0)::int)::double / nullif(sum((m or r0)::int), 0), 1) as ref,
  avg(x) filter (m) as cx, avg(y) filter (m) as cy from m group by clip, f),
st as (select *, sqrt(pow(cx - lag(cx) over w, 2) + pow(cy - lag(cy) over w, 2)) as step, abs(cov - lag(cov) over w) as change from fr window w as (partition by clip order by f))
select clip, round(stddev_pop(cov) / nullif(avg(cov), 0), 6) as coverage_cv, round(avg(change), 6) as change_mean, round(quantile_cont(change, 0.95), 6) as change_p95, round(avg(iou), 6) as iou_mean, round(quantile_cont(iou, 0.05), 6) as iou_p05,
  round(avg(ref), 6) as ref_mean, round(min(ref), 6) as ref_min, round(regr_slope(ref, f), 8) as ref_trend, round(avg(step), 6) as step_mean, round(quantile_cont(step, 0.95), 6) as step_p95, count(*) filter (cov = 0) as empty_frames, count(*) filter (cov = 1) as full_frames from st group by clip""")
def _(spark, d):
    px = px1(spark, d).withColumn("m", F.col("v") > 0.5)
    w = Window.partitionBy("clip", "y", "x").orderBy("f")
    px = px.withColumn("p", F.lag("m").over(w)).withColumn("r0", F.first("m").over(w))
    m, p, r0 = F.col("m"), F.col("p"), F.col("r0")

    def iou(a, b):
        return F.coalesce(F.try_divide(F.count_if(a & b), F.nullif(F.count_if(a | b), F.lit(0))), F.lit(1.0))

    fr = px.groupBy("clip", "f").agg(X.share(m).alias("cov"), F.when(F.col("f") > 0, iou(m, p)).alias("iou"), iou(m, r0).alias("ref"), F.avg(F.when(m, F.col("x"))).alias("cx"), F.avg(F.when(m, F.col("y"))).alias("cy"))
    c = Window.partitionBy("clip").orderBy("f")
    st = fr.withColumn("step", F.hypot(F.col("cx") - F.lag("cx").over(c), F.col("cy") - F.lag("cy").over(c))).withColumn("change", F.abs(F.col("cov") - F.lag("cov").over(c)))
    out = st.groupBy("clip").agg(
        X.ratio(F.stddev_pop("cov"), F.avg("cov")).alias("coverage_cv"), F.avg("change").alias("change_mean"), F.percentile("change", F.lit(0.95)).alias("change_p95"), F.avg("iou").alias("iou_mean"), F.percentile("iou", F.lit(0.05)).alias("iou_p05"),
        F.avg("ref").alias("ref_mean"), F.min("ref").alias("ref_min"), F.round(F.regr_slope("ref", "f"), 8).alias("ref_trend"), F.avg("step").alias("step_mean"), F.percentile("step", F.lit(0.95)).alias("step_p95"), F.count_if(F.col("cov") == 0).alias("empty_frames"), F.count_if(F.col("cov") == 1).alias("full_frames"),
    )
    return rounded(out, "coverage_cv", "change_mean", "change_p95", "iou_mean", "iou_p05", "ref_mean", "ref_min", "step_mean", "step_p95")


@query("a9_geometry", f"""with {PX1}, {_BOX}, j as (select px.clip, px.f, x, v, x0, x1, least(x0, y0, 8 - x1, 8 - y1) as clearance, (x1 - x0) * 0.22::double as band from px join bx using (clip, f))
select clip, f, any_value(clearance) as clearance, any_value(clearance) <= 0 as touches, round(avg((v > 0.7)::int), 6) as coverage,
  round(case when count(*) filter (v > 0.7 and x < x0 + band) >= count(*) filter (v > 0.7 and x >= x1 - band) then avg(v) filter (x >= x0 and x < x0 + band) else avg(v) filter (x < x1 and x >= x1 - band) end, 6) as lateral from j group by clip, f""")
def _(spark, d):
    px = px1(spark, d)
    j = px.join(P.box(px, F.col("v") > 0.7), ["clip", "f"])
    band, x, v = (F.col("x1") - F.col("x0")) * 0.22, F.col("x"), F.col("v")
    left, right = (x >= F.col("x0")) & (x < F.col("x0") + band), (x < F.col("x1")) & (x >= F.col("x1") - band)
    clearance = F.first(F.least("x0", "y0", 8 - F.col("x1"), 8 - F.col("y1")))
    larger = F.count_if((v > 0.7) & (x < F.col("x0") + band)) >= F.count_if((v > 0.7) & (x >= F.col("x1") - band))
    out = j.groupBy("clip", "f").agg(clearance.alias("clearance"), (clearance <= 0).alias("touches"), X.share(v > 0.7).alias("coverage"), F.when(larger, X.avg_where(v, left)).otherwise(X.avg_where(v, right)).alias("lateral"))
    return rounded(out, "coverage", "lateral")


@query("a23_silhouette", f"""with {PX1}, {_BOX}, fr as (select clip, f, avg(x) filter (v > 0.7) as cx, count(*) filter (v > 0.7) as area from px group by clip, f), j as (select * from fr join bx using (clip, f))
select clip, round(stddev_pop(x1 - x0) / avg(x1 - x0) * 100, 6) as width_cv_pct, round(stddev_pop(area) / avg(area) * 100, 6) as area_cv_pct, round(max(cx) - min(cx), 6) as centre_range from j group by clip""")
def _(spark, d):
    px = px1(spark, d)
    inside = F.col("v") > 0.7
    fr = px.groupBy("clip", "f").agg(F.avg(F.when(inside, F.col("x"))).alias("cx"), F.count_if(inside).alias("area")).join(P.box(px, inside), ["clip", "f"])
    w = F.col("x1") - F.col("x0")
    out = fr.groupBy("clip").agg((F.stddev_pop(w) / F.avg(w) * 100).alias("width_cv_pct"), (F.stddev_pop("area") / F.avg("area") * 100).alias("area_cv_pct"), (F.max("cx") - F.min("cx")).alias("centre_range"))
    return rounded(out, "width_cv_pct", "area_cv_pct", "centre_range")


@query("j12_plane_comparison", f"""with {PX1}, j as (select a.clip, a.f, floor(a.v * 255 + 0.5) as p, floor(b.v * 255 + 0.5) as r from px a join px b on a.clip = b.clip and a.y = b.y and a.x = b.x and b.f = a.f + 1),
fr as (select clip, f, avg(abs(p - r)) / 255 as mae, count(*) filter (p < 250 and r >= 250)::double / greatest(1, count(*) filter (r >= 250)) as soft, count(*) filter (p < 128 and r >= 250)::double / greatest(1, count(*) filter (r >= 250)) as hole,
  count(*) filter (p > 16 and r <= 5)::double / greatest(1, count(*) filter (r <= 5)) as leak from j group by clip, f)
select clip, round(avg(mae), 6) as alpha_mae, round(avg(soft), 6) as reference_interior_soft_fraction, round(avg(hole), 6) as reference_interior_hole_fraction, round(avg(leak), 6) as reference_background_leak_fraction from fr group by clip""")
def _(spark, d):
    px = px1(spark, d)
    reference = px.select("clip", (F.col("f") - 1).alias("f"), "y", "x", "v")
    out = P.plane_comparison(px, reference, "v")
    return rounded(out, *[c for c in out.columns if c != "clip"])


@query("j13_soft_detail", f"""with {PX4} select clip, f, count(*) filter (r between 0.02 and 0.98 and g between 0.02 and 0.98) as kept, count(*) filter (r between 0.02 and 0.98 and not (g between 0.02 and 0.98)) as lost,
  count(*) filter (b between 0.02 and 0.98 and not (r between 0.02 and 0.98)) as gained from px group by clip, f""")
def _(spark, d):
    px = px4(spark, d)
    planes = [px.select(*P.PIXEL, F.col(c).between(0.02, 0.98).alias(n)) for c, n in (("r", "base"), ("g", "one"), ("b", "two"))]
    j = planes[0].join(planes[1], P.PIXEL).join(planes[2], P.PIXEL)
    return j.groupBy("clip", "f").agg(F.count_if(F.expr("base and one")).alias("kept"), F.count_if(F.expr("base and not one")).alias("lost"), F.count_if(F.expr("two and not base")).alias("gained"))


@query("x4_distinct_alpha", f"with {PX4} select distinct clip, floor(a * 255 + 0.5)::bigint as q from px")
def _(spark, d):
    return px4(spark, d).select("clip", X.quantise(F.col("a")).alias("q")).distinct()


_MASK = "m as (select clip, f, y, x from px where v > 0.7)"
_CC = """cc as (select clip, f, y, x, y * 8 + x as l from m union select m.clip, m.f, m.y, m.x, cc.l from cc join m on m.clip = cc.clip and m.f = cc.f and abs(m.y - cc.y) <= 1 and abs(m.x - cc.x) <= 1),
lab as (select clip, f, y, x, min(l)::bigint as label from cc group by clip, f, y, x)"""


@query("i2_components", f"with recursive {PX1}, {_MASK}, {_CC} select clip, f, label, count(*) as area, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1, round(avg(x), 6) as cx, round(avg(y), 6) as cy from lab group by clip, f, label")
def _(spark, d):
    return rounded(P.components(px1(spark, d).where("v > 0.7"), 8), "cx", "cy")


@query("t6_largest_component", f"with recursive {PX1}, {_MASK}, {_CC}, c as (select clip, f, label, count(*) as area from lab group by all) select clip, f, arg_max(label, (area, -label)) as label, max(area) as area, count(*) as parts from c group by clip, f")
def _(spark, d):
    return P.largest(P.components(px1(spark, d).where("v > 0.7"), 8))


@query("a1_fragments", f"with recursive {PX4}, {_FRAG} select clip, f, round(fragment_pct, 6) as fragment_pct, fragment_count from frag")
def _(spark, d):
    return rounded(P.fragments(px4(spark, d), F.col("a") > 0.08, 4), "fragment_pct")


@query("i1_confident_regions", f"with recursive {PX4}, {REACHED} select clip, f, y, x, bg as background, fg as foreground from pc")
def _(spark, d):
    return P.confident(px4(spark, d).drop("score"), 4, 4).select(*P.PIXEL, F.col("bg").alias("background"), F.col("fg").alias("foreground"))


@query("i3_normalised_background", f"""with recursive {PX1}, m as (select clip, f, y, x from px where v > 0.55), {_CC}, e as (select distinct clip, f, label from lab where x in (0, 7) or y in (0, 7)),
h as (select px.*, (e.label is not null)::int as hit from px left join lab using (clip, f, y, x) left join e on e.clip = px.clip and e.f = px.f and e.label = lab.label),
gr as (select a.clip, a.f, a.y, a.x, max(b.hit) as grown from h a join h b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all)
select clip, f, round(avg(grown), 6) as coverage, avg(grown) < 0.3 or avg(grown) > 0.9 as suspicious from gr group by clip, f""")
def _(spark, d):
    px = px1(spark, d)
    reached = P.labelled(px.where("v > 0.55"), 8, 8).select(*P.PIXEL, F.lit(1).alias("hit"))
    grown = P.morphology(px.join(reached, P.PIXEL, "left").select(*P.PIXEL, F.coalesce("hit", F.lit(0)).alias("grown")), "grown", "max", 1)
    return rounded(grown.groupBy("clip", "f").agg(F.avg("grown").alias("coverage"), ((F.avg("grown") < 0.3) | (F.avg("grown") > 0.9)).alias("suspicious")), "coverage")


@query("i5_component_rules", f"""with recursive {PX1}, {_MASK}, {_CC}, c as (select clip, f, label, count(*) as area, min(x) as x0, min(y) as y0, max(x) + 1 as x1, max(y) + 1 as y1 from lab group by all),
mn as (select clip, f, arg_max(label, (area, -label)) as ml from c group by clip, f), mb as (select c.* from c join mn on mn.clip = c.clip and mn.f = c.f and mn.ml = c.label)
select c.clip, c.f, c.label, c.area from c join mb using (clip, f) where c.label = mb.label or c.area >= 0.08 * mb.area or (c.x0 < mb.x1 + 1 and c.x1 > mb.x0 - 1 and c.y0 < mb.y1 + 1 and c.y1 > mb.y0 - 1)""")
def _(spark, d):
    c = P.components(px1(spark, d).where("v > 0.7"), 8)
    main = c.join(P.largest(c).select("clip", "f", "label"), ["clip", "f", "label"]).select("clip", "f", *[F.col(k).alias(f"m_{k}") for k in ("label", "area", "x0", "y0", "x1", "y1")])
    keep = F.expr("label = m_label or area >= 0.08 * m_area or (x0 < m_x1 + 1 and x1 > m_x0 - 1 and y0 < m_y1 + 1 and y1 > m_y0 - 1)")
    return c.join(main, ["clip", "f"]).where(keep).select("clip", "f", "label", "area")


def _square(how: str, r: int) -> str:
    return f"with {PX1} select a.clip, a.f, a.y, a.x, round({how}(b.v), 6) as v from px a join px b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= {r} and abs(a.x - b.x) <= {r} group by all"


@query("w9_dilate", _square("max", 1))
def _(spark, d):
    return rounded(P.morphology(px1(spark, d), "v", "max", 1), "v")


@query("w9_erode", _square("min", 1))
def _(spark, d):
    return rounded(P.morphology(px1(spark, d), "v", "min", 1), "v")


@query("w9_box_blur", _square("avg", 2))
def _(spark, d):
    return rounded(P.morphology(px1(spark, d), "v", "avg", 2), "v")


@query("w9_close", f"""with {PX1}, hi as (select a.clip, a.f, a.y, a.x, max(b.v) as v from px a join px b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all)
select a.clip, a.f, a.y, a.x, round(min(b.v), 6) as v from hi a join hi b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all""")
def _(spark, d):
    return rounded(P.morphology(P.morphology(px1(spark, d), "v", "max", 1), "v", "min", 1), "v")


@query("i4_boundary_distance", f"""with {PX1}, near as (select a.clip, a.f, a.y, a.x, min(sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2))) as dist from px a join px b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 3 and abs(a.x - b.x) <= 3 where a.v > 0.4 and b.v <= 0.4 group by all)
select px.clip, px.f, px.y, px.x, round(least(coalesce(dist, 4), 4), 6) as distance from px left join near using (clip, f, y, x) where px.v > 0.4""")
def _(spark, d):
    near = P.nearest(px1(spark, d), F.col("v") > 0.4, F.col("v") <= 0.4, "v", 3)
    return rounded(near.select(*P.PIXEL, F.least(F.coalesce("distance", F.lit(4.0)), F.lit(4.0)).alias("distance")), "distance")


@query("c18_feather", f"""with {PX1}, near as (select a.clip, a.f, a.y, a.x, min(sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2))) as dist from px a join px b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 3 and abs(a.x - b.x) <= 3 where a.v > 0.4 and b.v <= 0.4 group by all)
select px.clip, px.f, px.y, px.x, round(least(0.96, greatest(0.62, 0.56::double + 0.13::double * least(coalesce(dist, 4), 4))), 6) as alpha from px left join near using (clip, f, y, x) where px.v > 0.4""")
def _(spark, d):
    near = P.nearest(px1(spark, d), F.col("v") > 0.4, F.col("v") <= 0.4, "v", 3)
    return rounded(near.select(*P.PIXEL, X.clamp(0.56 + 0.13 * F.least(F.coalesce("distance", F.lit(4.0)), F.lit(4.0)), 0.62, 0.96).alias("alpha")), "alpha")


@query("a11_edge_luminance", f"""with {PX4}, near as (select a.clip, a.f, a.y, a.x, min(sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2))) as dist from px a join px b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 3 and abs(a.x - b.x) <= 3 where a.a > 0.04 and b.a <= 0.04 group by all),
j as (select px.*, coalesce(dist, 4) as d, r * 0.2126::double + g * 0.7152::double + b * 0.0722::double as luma, greatest(r, g, b) - least(r, g, b) as neutral from px left join near using (clip, f, y, x) where px.a > 0.04),
e as (select clip, f, coalesce(avg(luma) filter (d <= 1), 0) as edge, avg(luma) filter (d >= 1.2 and d <= 4 and a > 0.96) as inner0, count(*) filter (d <= 1 and luma > 0.82 and neutral < 0.22) * 100.0::double / greatest(1, count(*) filter (d <= 1)) as bright from j group by clip, f)
select clip, f, round(edge, 6) as edge_luma_mean, round(coalesce(inner0, edge), 6) as inner_luma_mean, round(edge - coalesce(inner0, edge), 6) + 0.0 as edge_luma_excess, round(bright, 6) as bright_neutral_edge_pct from e""")
def _(spark, d):
    return rounded(P.edge_luminance(px4(spark, d), 1.0, (1.2, 4.0), 3), "edge_luma_mean", "inner_luma_mean", "edge_luma_excess", "bright_neutral_edge_pct").withColumn("edge_luma_excess", F.col("edge_luma_excess") + 0.0)


@query("j15_nearest_core_colour", f"""with {PX4}, near as (select a.clip, a.f, a.y, a.x, arg_min(b.g, (pow(b.y - a.y, 2) + pow(b.x - a.x, 2), b.y, b.x)) as core_g from px a join px b on a.clip = b.clip and a.f = b.f and abs(a.y - b.y) <= 3 and abs(a.x - b.x) <= 3 where not a.fg and b.fg group by all)
select px.clip, px.f, px.y, px.x, round(core_g, 6) as core_g from px left join near using (clip, f, y, x) where not px.fg""")
def _(spark, d):
    px = px4(spark, d)
    return rounded(P.nearest(px, ~F.col("fg"), F.col("fg"), "g", 3).select(*P.PIXEL, F.col("g").alias("core_g")), "core_g")
