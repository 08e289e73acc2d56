"""Diagnostics of mattes and masks over clips: a row for each clip from the pixels of its frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions import exprs as X
from framewell.operators import pixels as P


def _parts(px: DataFrame, inside: Column, width: int) -> DataFrame:
    """(clip, f, parts, cx, cy): the components inside, and the centre of the largest, of equal ones the first; frames without one have no row."""
    each = P.components(px.where(inside), width)
    at = F.struct("area", -F.col("label"))
    return each.groupBy(*P.FRAME).agg(F.count("*").alias("parts"), F.max_by("cx", at).alias("cx"), F.max_by("cy", at).alias("cy"))


def _variation(of: str) -> Column:
    """Standard deviation by mean, 0 for one frame or where the mean is 0."""
    return F.when((F.count(of) > 1) & (F.avg(of) > 0), F.stddev_pop(of) / F.avg(of)).otherwise(0.0)


def alpha_diagnostics(px: DataFrame, width: int, height: int, visible: int = 16, opaque: int = 250) -> DataFrame:
    """Of px (clip, f, y, x, q: alpha from 0 to 255): values, coverage, soft share, steps between frames, components, how far the largest one's centre wanders, frames that touch the edge or are empty. Clips of one frame have null steps."""
    q, seen = F.col("q"), F.col("q") >= visible
    edge = F.col("x").isin(0, width - 1) | F.col("y").isin(0, height - 1)
    values = px.groupBy("clip").agg(F.count_distinct("q").alias("alpha_unique_value_count"), F.min("q").alias("alpha_value_min"), F.max("q").alias("alpha_value_max"))
    frame = P.consecutive(px, "q").groupBy(*P.FRAME).agg(
        X.share(seen).alias("cover"), X.share((q > 0) & (q < opaque)).alias("soft"), (F.avg(F.abs(q - F.col("prev"))) / 255).alias("step"), F.max((seen & edge).cast("int")).alias("edge")
    ).join(_parts(px, seen, width), P.FRAME, "left")
    out = frame.groupBy("clip").agg(
        F.avg("cover").alias("visible_coverage_mean"), _variation("cover").alias("visible_coverage_cv"), F.min("cover").alias("visible_coverage_min"), F.max("cover").alias("visible_coverage_max"), F.avg("soft").alias("soft_alpha_coverage_mean"),
        F.avg("step").alias("consecutive_alpha_mae_mean"), F.percentile("step", F.lit(0.95)).alias("consecutive_alpha_mae_p95"),
        F.coalesce(F.max("cx") - F.min("cx"), F.lit(0.0)).alias("centroid_span_x"), F.coalesce(F.max("cy") - F.min("cy"), F.lit(0.0)).alias("centroid_span_y"),
        F.coalesce(F.max("parts"), F.lit(0)).alias("component_count_max"), F.sum("edge").alias("edge_touch_frames"), F.count_if(F.col("cover") == 0).alias("empty_frames"),
    )
    return values.join(out, "clip")


def _iou(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(a & b), F.nullif(F.count_if(a | b), F.lit(0))), F.lit(1.0))


def mask_diagnostics(px: DataFrame, width: int) -> DataFrame:
    """Of px (clip, f, y, x, m: a mask, q: the reference's alpha from 0 to 255, r: the reference's mask): coverage and its changes, agreement with the frame before and with the reference and its trend, holes and leaks, whether the mask holds the reference's soft band, steps of the centre, components. What needs two frames is null for clips of one."""
    m, r, q = F.col("m"), F.col("r"), F.col("q")
    soft, inside, outside = (q > 8) & (q < 247), q >= 250, q <= 5

    def part(hit: Column, of: Column, empty: float = 0.0) -> Column:
        return F.coalesce(F.try_divide(F.count_if(hit & of), F.nullif(F.count_if(of), F.lit(0))), F.lit(empty))

    before = F.col("prev")
    frame = P.consecutive(px, "m").groupBy(*P.FRAME).agg(
        X.share(m).alias("area"), X.share(r).alias("reference_area"), F.when(F.count("prev") > 0, _iou(m, before)).alias("iou"), _iou(m, r).alias("reference_iou"),
        X.share(soft).alias("soft"), part(m, soft, 1.0).alias("contained"), F.avg(F.abs(m.cast("int") - q / 255)).alias("alpha_mae"), part(~m, inside).alias("holes"), part(m, outside).alias("leaks"),
        F.avg(F.when(m, F.col("x"))).alias("cx"), F.avg(F.when(m, F.col("y"))).alias("cy"),
    ).join(_parts(px, m, width).select(*P.FRAME, "parts"), P.FRAME, "left")
    w = Window.partitionBy("clip").orderBy("f")
    steps = frame.withColumn("step", F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))).withColumn("change", F.abs(F.col("area") - F.lag("area").over(w)))

    def low(c: str, share: float) -> Column:
        return F.percentile(c, F.lit(share))

    return steps.groupBy("clip").agg(
        F.avg("area").alias("mask_coverage_mean"), F.min("area").alias("mask_coverage_min"), F.max("area").alias("mask_coverage_max"), (F.stddev_pop("area") / F.greatest(F.avg("area"), F.lit(1e-12))).alias("mask_coverage_cv"),
        F.avg("change").alias("absolute_area_change_mean"), low("change", 0.95).alias("absolute_area_change_p95"), F.avg("iou").alias("consecutive_mask_iou_mean"), low("iou", 0.05).alias("consecutive_mask_iou_p05"),
        F.avg("reference_iou").alias("reference_iou_mean"), low("reference_iou", 0.05).alias("reference_iou_p05"), F.min("reference_iou").alias("reference_iou_min"), F.regr_slope("reference_iou", "f").alias("reference_iou_trend"),
        F.avg(F.abs(F.col("area") - F.col("reference_area"))).alias("reference_area_mae"), F.avg("alpha_mae").alias("reference_alpha_mae"), F.avg("holes").alias("interior_hole_fraction"), F.avg("leaks").alias("background_leak_fraction"),
        F.avg("step").alias("centroid_step_mean"), low("step", 0.95).alias("centroid_step_p95"), F.coalesce(F.max("parts"), F.lit(0)).alias("component_count_max"), F.count_if(F.col("area") == 0).alias("empty_frames"), F.count_if(F.col("area") == 1).alias("full_frames"),
        F.avg("soft").alias("soft_band_fraction_mean"), F.avg("contained").alias("soft_band_containment_mean"),
    )


def geometry(px: DataFrame, width: int, height: int, edge: int = 4, band: float = 0.22, visible: float = 0.08) -> DataFrame:
    """Of px (clip, f, y, x, a: the output's alpha, s: the source's foreground mask): a row for each clip.

    The subject is the largest part over `visible`. Frames whose subject comes within `edge` pixels of the border, or
    that have none, touch it; those whose source does are at risk. Of the two bands at the sides of the source's
    foreground, a share `band` of its width each, the one with more pixels counts, the left one of equals: its mean alpha
    and the share that belongs to the subject, 0 without one. Clearance is 0 without a subject.
    """
    a, s, x = F.col("a"), F.col("s"), F.col("x")
    parts = P.labelled(px.where(a > visible), width)
    main = P.largest(parts.groupBy(*P.FRAME, "label").agg(F.count("*").alias("area"))).select(*P.FRAME, "label")
    subject = parts.join(main, [*P.FRAME, "label"], "left_semi").select(*P.PIXEL, F.lit(True).alias("_main"))
    rows = px.join(subject, P.PIXEL, "left").withColumn("_main", F.coalesce("_main", F.lit(False)))

    def nearest(inside: Column) -> Column:
        low, high = F.least(F.min(F.when(inside, x)), F.min(F.when(inside, F.col("y")))), F.least(width - 1 - F.max(F.when(inside, x)), height - 1 - F.max(F.when(inside, F.col("y"))))
        return F.least(low, high)

    boxes = rows.groupBy(*P.FRAME).agg(nearest(F.col("_main")).alias("clearance"), nearest(s).alias("source_clearance"), X.share(F.col("_main")).alias("cover"), F.min(F.when(s, x)).alias("_x0"), F.max(F.when(s, x)).alias("_x1"))
    reach = F.greatest(F.lit(1), F.col("_x1") - F.col("_x0") + 1) * band
    left, right = s & (x <= F.col("_x0") + reach), s & (x >= F.col("_x1") - reach)
    bands = rows.join(boxes.select(*P.FRAME, "_x0", "_x1"), P.FRAME).groupBy(*P.FRAME).agg(
        (F.count_if(left) >= F.count_if(right)).alias("_left"), *[F.avg(F.when(side, v)).alias(f"_{name}_{n}") for n, side in (("l", left), ("r", right)) for name, v in (("a", a), ("m", F.col("_main").cast("int")))]
    )
    has = F.col("clearance").isNotNull()
    frame = boxes.join(bands, P.FRAME)

    def band_of(name: str) -> Column:
        return F.when(has, F.coalesce(F.when(F.col("_left"), F.col(f"_{name}_l")).otherwise(F.col(f"_{name}_r")), F.lit(0.0))).otherwise(0.0)

    return frame.groupBy("clip").agg(
        F.count_if(~has | (F.col("clearance") <= edge)).alias("border_touch_frames"), F.count_if(has & (F.col("source_clearance") <= edge)).alias("source_border_risk_frames"),
        F.min(F.coalesce("clearance", F.lit(0))).alias("min_subject_clearance_px"), F.avg(F.coalesce("clearance", F.lit(0))).alias("mean_subject_clearance_px"), F.avg(F.when(has, F.col("cover") * 100)).alias("subject_coverage_pct"),
        F.avg(band_of("a")).alias("lateral_alpha_retention"), F.avg(band_of("m")).alias("lateral_main_component_ratio"),
    )


def union_box(px: DataFrame, inside: Column, width: int, height: int, margin: int) -> DataFrame:
    """(clip, x0, y0, x1, y1, left, top, right, bottom): the box around all frames' pixels inside, exclusive at the end, and the sides at which it comes within `margin` pixels of the border. Clips without any have no row."""
    box = px.where(inside).groupBy("clip").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return box.select("*", (F.col("x0") <= margin).alias("left"), (F.col("y0") <= margin).alias("top"), (width - F.col("x1") <= margin).alias("right"), (height - F.col("y1") <= margin).alias("bottom"))


def temporal_alpha(px: DataFrame, names: DataFrame, least: float = 0.02) -> DataFrame:
    """(clip, temporal_alpha_mae_static): the mean over steps of the mean difference of alpha `a` where this frame or the one before is visible; the same place is compared, without optical flow.

    names: (clip, f, name). Null for clips of one frame, for those without a visible pixel, and where a frame's name is not
    f_ and a number, since frames may not follow each other then. A frame whose pixels are not those of the one
    before is an error.
    """
    ordered = names.groupBy("clip").agg(F.bool_and(F.rlike(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit(r"^f_[0-9]+$"))).alias("ordered"))
    sizes = px.groupBy(*P.FRAME).agg(F.max("x").alias("w"), F.max("y").alias("h"), F.count("*").alias("n")).groupBy("clip").agg(F.count_distinct("w", "h", "n").alias("shapes"))
    checked = ordered.join(sizes, "clip").withColumn("ordered", F.when(F.col("shapes") > 1, F.raise_error(F.concat(F.lit("frames of different sizes in clip "), F.col("clip").cast("string"))).cast("boolean")).otherwise(F.col("ordered")))
    both = P.consecutive(px, "a").where((F.col("prev") > least) | ((F.col("a") > least) & F.col("prev").isNotNull()))
    steps = both.groupBy(*P.FRAME).agg(F.avg(F.abs(F.col("a") - F.col("prev"))).alias("step")).groupBy("clip").agg(F.avg("step").alias("mae"))
    return checked.join(steps, "clip", "left").select("clip", F.when(F.col("ordered"), F.col("mae")).alias("temporal_alpha_mae_static"))
