"""Operators on clips: ordered frames with a signature array `e`, and pixel tables over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions import exprs as X
from framewell.operators import pixels as P


def counted(frames: DataFrame) -> DataFrame:
    """frames plus n, the frames of the clip."""
    return frames.join(frames.groupBy("clip").agg(F.count("*").cast("int").alias("n")), "clip")


def every_nth(frames: DataFrame, k: int, cap: bool = False) -> DataFrame:
    """Every max(1, n // k)-th frame, at most k of them if capped."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    out = counted(frames).where(F.col("f") % step == 0)
    return (out.where(F.floor(F.col("f") / step) < k) if cap else out).drop("n")


def uniform(frames: DataFrame, k: int) -> DataFrame:
    """k frames at even distances, rounded half to even; short clips repeat frames. Adds slot."""
    n = frames.groupBy("clip").agg(F.count("*").alias("n"))
    slots = n.select("clip", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    wanted = slots.select("clip", "slot", F.rint(F.col("slot") * (F.col("n") - 1) / F.lit(max(1, k - 1))).cast("int").alias("f"))
    return wanted.join(frames, ["clip", "f"])


def ends_and_middle(frames: DataFrame) -> DataFrame:
    n = F.col("n")
    return counted(frames).where((F.col("f") == 0) | (F.col("f") == F.floor(n / 2)) | (F.col("f") == n - 1)).drop("n")


def trimmed(frames: DataFrame, most: int = 6, keep: int = 24) -> DataFrame:
    """Drops min(most, n // 5) frames at either end if at least `keep` remain."""
    n, f = F.col("n"), F.col("f")
    cut = F.least(F.lit(most), F.floor(n / 5))
    cut = F.when(n - 2 * cut >= keep, cut).otherwise(0)
    return counted(frames).where((f >= cut) & (f < n - cut)).drop("n")


def best_span(frames: DataFrame, start_below: int, least: int) -> DataFrame:
    """Per clip the loop span with the most similar ends: `least` frames on at least, start at most start_below and n - least - 1; late starts and early ends cost a little. Modes: too_short (fewer than least + 2 frames), not_found, best_span.

    A range self-join inside a clip; the start side is bounded, so a clip of n frames makes n * start_below pairs.
    """
    clips = frames.groupBy("clip").agg(F.count("*").cast("int").alias("n"))
    long = clips.where(F.col("n") >= least + 2)
    a = frames.where(F.col("f") <= start_below).select("clip", F.col("f").alias("start"), F.col("e").alias("ea"))
    b = frames.select("clip", F.col("f").alias("end"), F.col("e").alias("eb"))
    pairs = a.join(b, "clip").where(F.col("end") >= F.col("start") + least).join(long, "clip").where(F.col("start") <= F.col("n") - least - 1)
    score = F.round(X.l1_mean(F.col("ea"), F.col("eb")) + 0.000025 * (F.col("n") - F.col("end")) + 0.00004 * F.col("start"), 9)
    best = pairs.select("clip", "start", "end", score.alias("score")).groupBy("clip").agg(F.min(F.struct("score", "start", "end")).alias("_b"))
    out = clips.join(best, "clip", "left")
    mode = F.when(F.col("n") < least + 2, "too_short").when(F.col("_b").isNull(), "not_found").otherwise("best_span")
    return out.select("clip", "n", mode.alias("mode"), "_b.start", "_b.end", "_b.score")


def crossfade(frames: DataFrame, most: int = 8) -> DataFrame:
    """The closed clip (clip, f, e): its frames, the last k = min(most, n // 5) blended with the first k, the weight rising to the head's."""
    rows = counted(frames).withColumn("k", F.least(F.lit(most), F.floor(F.col("n") / 5)))
    head = rows.where(F.col("f") < F.col("k")).select("clip", F.col("f").cast("long").alias("i"), F.col("e").alias("h"))
    i = F.col("f") - (F.col("n") - F.col("k"))
    w = (F.col("i") + 1) / (F.col("k") + 1)
    both = rows.withColumn("i", i).join(head, ["clip", "i"], "left")
    return both.select("clip", "f", F.when(F.col("h").isNull(), F.col("e")).otherwise(F.zip_with("e", "h", lambda t, h: t * (1 - w) + h * w)).alias("e"))


def seam(frames: DataFrame, limit: float = 0.012) -> DataFrame:
    """Distance of a clip's last frame to its first, and whether it may close directly."""
    ends = frames.groupBy("clip").agg(F.min_by("e", "f").alias("a"), F.max_by("e", "f").alias("b"))
    distance = X.l1_mean(F.col("a"), F.col("b"))
    return ends.select("clip", distance.alias("seam"), F.when(distance <= limit, "direct").otherwise("crossfade").alias("closure"))


def motion(px: DataFrame, value: str, threshold: float, grow: int = 1) -> DataFrame:
    """(clip, f, y, x, motion): the pixel, or one at most `grow` away, differs from the frame before or after by over the threshold."""
    w = Window.partitionBy("clip", "y", "x").orderBy("f")
    v = F.col(value)
    step = F.greatest(F.coalesce(F.abs(v - F.lag(value).over(w)), F.lit(0.0)), F.coalesce(F.abs(v - F.lead(value).over(w)), F.lit(0.0)))
    moved = px.select(*P.PIXEL, (step > threshold).cast("int").alias("motion"))
    return P.morphology(moved, "motion", "max", grow)


def _folded(kinds: dict[str, str]):
    """Rows (clip, f, y, x, v, w, place) of some pixels of a clip, v moved by w towards the result at the place before; the frame at the first place stays as it is."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("y", "ascending"), ("x", "ascending")])
        v, w = (rows[c].to_numpy().copy() for c in ("v", "w"))
        pixel = np.unique(rows["y"].to_numpy().astype(np.int64) << 32 | rows["x"].to_numpy(), return_inverse=True)[1]
        place = rows["place"].to_numpy()
        last = np.full(pixel.max() + 1, np.nan)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        for i, j in zip(starts, np.append(starts[1:], len(v))):
            at, before = pixel[i:j], last[pixel[i:j]]
            out = v[i:j] + w[i:j] * (before - v[i:j])
            out = np.where(out < 0.012, 0.0, np.where(out > 0.992, 1.0, out))
            last[at] = v[i:j] = np.where(np.isnan(before), v[i:j], out)
        return rows.select(P.PIXEL).append_column("v", pa.array(v))

    return run, ", ".join(f"{c} {kinds[c]}" for c in P.PIXEL) + ", v double"


def smoothed(px: DataFrame, value: str, source: list[str], static: float = 0.65, band: float = 0.5, still: float = 0.006, trusted: float = 0.09, both: bool = True, lower: bool = False) -> DataFrame:
    """(clip, f, y, x, value): each pixel's alpha drawn to the smoothed one of the frame before, then, with `both`, of the frame after; without optical flow, so that a pixel's neighbour is the same place.

    The pull is `static` where the source's colours (mean difference over a 3 x 3 window) moved by less than
    `still`, else `band` at most one pixel from a soft alpha, else none; all of it falls to 0 as the difference
    nears `trusted`. Values under 0.012 and over 0.992 snap to 0 and 1. Clips of fewer than 3 frames stay as
    they are. lower: the lower part of the subject's box keeps its alpha, since fast feet leave ghosts.
    Pixels are dealt by clip, row and tiles of 64, so that a task holds a tile's series and not a clip.
    """
    w = Window.partitionBy("clip", "y", "x").orderBy("f")
    step = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in source), F.lit(0.0)) / len(source)
    base = px.select(*P.PIXEL, F.col(value).cast("double").alias("v"), step.alias("moved"))
    moved = P.morphology(base, "moved", "avg", 1).withColumn("moved_next", F.lead("moved").over(w))

    def swept(rows: DataFrame, change: str, place: Column) -> DataFrame:
        rows = P.morphology(rows.withColumn("soft", ((F.col("v") > 0.02) & (F.col("v") < 0.98)).cast("int")), "soft", "max", 1)
        pull = F.when(F.col(change) < still, static).when(F.col("soft") == 1, band).otherwise(0.0)
        weight = F.coalesce(X.clamp(1 - F.col(change) / trusted) * pull, F.lit(0.0))
        run, schema = _folded(dict(rows.dtypes))
        held = rows.select(*P.PIXEL, "v", weight.alias("w"), place.alias("place"), F.floor(F.col("x") / 64).alias("tile"))
        return held.groupBy("clip", "y", "tile").applyInArrow(lambda group: run(group.drop_columns("tile")), schema)

    out = swept(moved, "moved", F.col("f").cast("long"))
    if both:
        out = swept(out.join(moved.select(*P.PIXEL, "moved_next"), P.PIXEL), "moved_next", -F.col("f").cast("long"))
    n = base.groupBy("clip").agg(F.count_distinct("f").alias("n"))
    rows = base.select(*P.PIXEL, F.col("v").alias("was")).join(out, P.PIXEL).join(n, "clip")
    kept = F.col("n") < 3
    if lower:
        tall = base.where("v > 0.55").groupBy(*P.FRAME).agg((F.min("y") + F.rint((F.max("y") - F.min("y") + 1) * 0.52)).alias("cut"))
        rows = rows.join(tall, P.FRAME, "left")
        kept = kept | F.coalesce(F.col("y") >= F.col("cut"), F.lit(False))
    return rows.select(*P.PIXEL, F.when(kept, F.col("was")).otherwise(F.col("v")).alias(value))


def unsupported_fragments(mask: DataFrame, full: DataFrame, width: int, support: float = 0.25, cap: float = 0.08, least: int = 1) -> DataFrame:
    """Per frame: detached components, those removed since too few of their pixels are near the mask of the frame before or after, and those that their size protects.

    mask: the mask's pixels; full: all pixels of the frames.
    """
    marked = P.labelled(mask, width)
    size = full.groupBy("clip", "f").agg(F.count("*").alias("pixels"))
    plane = full.join(mask.select(*P.PIXEL, F.lit(1).alias("_m")), P.PIXEL, "left").select(*P.PIXEL, F.coalesce("_m", F.lit(0)).alias("m"))
    near = P.morphology(plane, "m", "max", 1).where("m = 1")
    around = near.select("clip", (F.col("f") + 1).alias("f"), "y", "x").union(near.select("clip", (F.col("f") - 1).alias("f"), "y", "x")).distinct().withColumn("s", F.lit(1))
    parts = marked.join(around, P.PIXEL, "left").groupBy("clip", "f", "label").agg(F.count("*").alias("area"), F.count("s").alias("supported"))
    main = P.largest(parts).select("clip", "f", F.col("label").alias("main"))
    detached = parts.join(main, ["clip", "f"]).where("label <> main").join(size, ["clip", "f"])
    small = F.col("area") <= F.col("pixels") * cap
    weak = F.col("supported") < F.greatest(F.lit(float(least)), F.col("area") * support)
    return detached.groupBy("clip", "f").agg(F.count("*").alias("detached"), F.count_if(small & weak).alias("removed"), F.sum(F.when(small & weak, F.col("area")).otherwise(0)).alias("pixels_removed"), F.count_if(~small & weak).alias("protected"))


def repaired(px: DataFrame, mask: DataFrame, value: str, floor: float, severe: float, grow: int = 1) -> DataFrame:
    """px with alpha raised to the floor in the core of a mask plane (column m, 0 or 1; eroded by `grow`), never lowered. Adds was, core."""
    core = P.morphology(mask.select(*P.PIXEL, "m"), "m", "min", grow)
    out = px.join(core, P.PIXEL, "left")
    inside = F.coalesce(F.col("m"), F.lit(0)) == 1
    return out.select(*P.PIXEL, F.col(value).alias("was"), inside.alias("core"), F.when(inside, F.greatest(F.col(value), F.lit(floor))).otherwise(F.col(value)).alias(value), (inside & (F.col(value) < severe)).alias("severe"))


def unmixed(px: DataFrame, excess: str, radius: int = 1) -> DataFrame:
    """Coverage of a linear mix with the key: 1 - excess / the mean excess around."""
    local = P.morphology(px.select(*P.PIXEL, F.col(excess).alias("_local")), "_local", "avg", radius)
    return px.join(local, P.PIXEL).select(*P.PIXEL, X.clamp(1 - F.col(excess) / F.greatest("_local", F.lit(1e-6))).alias("coverage"))


def adaptive_key(px: DataFrame, profile: DataFrame) -> DataFrame:
    """Alpha and colours from each clip's own key profile: ramp, recovery of the foreground colour, spill cap."""
    keyed = px.join(profile.select("clip", "bg_floor", "key_r", "key_g", "key_b", "status"), "clip")
    alpha = X.key_ramp(F.col("score"), F.col("bg_floor"))
    out = keyed.select(*P.PIXEL, "status", alpha.alias("alpha"), *[X.recover(F.col(c), alpha, F.col(f"key_{c}")).alias(c) for c in "rgb"])
    return out.withColumn("g", X.spill_cap(F.col("r"), F.col("g"), F.col("b")))


def clip_report(keyed: DataFrame, seams: DataFrame, least_visible: Column | float = 0.04) -> DataFrame:
    """A metrics row for each clip: visible share, fallback status, closure."""
    seen = keyed.groupBy("clip").agg(F.count_distinct("f").alias("frames"), X.share(F.col("alpha") > 0.05).alias("visible"), F.first("status").alias("profile"))
    status = F.when(F.col("profile") == "fail", "fallback").when(F.col("visible") < least_visible, "fallback").otherwise("ok")
    return seen.join(seams, "clip").select("clip", "frames", "visible", status.alias("status"), "closure")


def voted_fragments(px: DataFrame, value: str, width: int, pixels: int, solid: float = 0.5, visible: float = 0.05, near: float = 0.05, support: float = 0.25, least: int = 3, cap: int = 96, cap_share: float = 0.0015) -> tuple[DataFrame, DataFrame]:
    """Small detached parts that the frames before and after don't have: (px with the value 0 there, counts for each frame).

    A frame's body is its largest part over `solid`; parts over `visible` that hold none of it are detached. Those of more
    than max(cap, pixels * cap_share) pixels are protected, whatever their neighbours show; the others are removed unless
    max(least, area * support) pixels of theirs are at most one pixel from a pixel over `near` in frame f - 1 or f + 1. Frames
    without a solid pixel, and those without a neighbour, keep all. pixels: of a frame. Counts: detached, removed,
    pixels_removed, protected, for frames with a body and a neighbour.
    """
    body = P.labelled(px.where(F.col(value) > solid), width)
    main = P.largest(body.groupBy(*P.FRAME, "label").agg(F.count("*").alias("area"))).select(*P.FRAME, "label")
    core = body.join(main, [*P.FRAME, "label"], "left_semi").select(*P.PIXEL, F.lit(1).alias("_core"))
    hits = px.select(*P.PIXEL, (F.col(value) > near).cast("int").alias("_near"))
    seen = P.morphology(hits, "_near", "max", 1)
    around = seen.select("clip", (F.col("f") + 1).alias("f"), "y", "x", "_near").unionByName(seen.select("clip", (F.col("f") - 1).alias("f"), "y", "x", "_near")).groupBy(*P.PIXEL).agg(F.max("_near").alias("_near"))
    parts = P.labelled(px.where(F.col(value) > visible), width)
    judged = parts.join(core, P.PIXEL, "left").join(around, P.PIXEL, "left").groupBy(*P.FRAME, "label").agg(F.count("*").alias("area"), F.count("_core").alias("held"), F.sum(F.coalesce("_near", F.lit(0))).alias("supported"), F.count("_near").alias("_known"))
    # a frame has a neighbour where its pixels have one
    detached = judged.join(main.select(*P.FRAME), P.FRAME, "left_semi").where("held = 0 and _known > 0")
    large = F.col("area") > max(cap, int(pixels * cap_share))
    weak = ~large & (F.col("supported") < F.greatest(F.lit(least), F.floor(F.col("area") * support)))
    detached = detached.select(*P.FRAME, "label", "area", large.alias("_large"), weak.alias("_weak"))
    counts = detached.groupBy(*P.FRAME).agg(F.count("*").alias("detached"), F.count_if("_weak").alias("removed"), F.sum(F.when(F.col("_weak"), F.col("area")).otherwise(0)).alias("pixels_removed"), F.count_if("_large").alias("protected"))
    gone = parts.join(detached.where("_weak"), [*P.FRAME, "label"], "left_semi").select(*P.PIXEL, F.lit(True).alias("_gone"))
    return px.join(gone, P.PIXEL, "left").withColumn(value, F.when(F.col("_gone"), 0.0).otherwise(F.col(value))).drop("_gone"), counts
