"""Operators on pixel tables (clip, f, y, x, and channels or one plane in 0..1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewell.functions import exprs as X

FRAME = ["clip", "f"]
PIXEL = ["clip", "f", "y", "x"]


def pixels_of(frames: DataFrame, planes: Sequence[str], width: int) -> DataFrame:
    """Frames with one array per plane become pixel rows."""
    zipped = F.arrays_zip(*[F.col(p).alias(p) for p in planes])
    rows = frames.select(*FRAME, F.posexplode(zipped).alias("_pos", "_v"))
    return rows.select(*FRAME, F.floor(F.col("_pos") / width).cast("int").alias("y"), (F.col("_pos") % width).cast("int").alias("x"), *[F.col("_v")[p].alias(p) for p in planes])


def with_score(px: DataFrame) -> DataFrame:
    return px.withColumn("score", X.green_dominance(F.col("r"), F.col("g"), F.col("b")))


def regions(px: DataFrame, background: float = 0.42, foreground: float = 0.025, dark: float = 0.10) -> DataFrame:
    """px with score, bg and fg: confident background by score, confident foreground by score or a dark green channel."""
    s = F.col("score")
    return with_score(px).withColumn("bg", s > background).withColumn("fg", (s < foreground) | (F.col("g") < dark))


def confident(px: DataFrame, width: int, height: int, candidate: float = 0.32, least_green: float = 0.18, background: float = 0.42) -> DataFrame:
    """regions() of px, with reached (candidates for background whose component touches the border) and bg (reached and of a high score)."""
    px = regions(px)
    found = labelled(px.where((F.col("score") > candidate) & (F.col("g") > least_green)), width, height).select(*PIXEL, F.lit(True).alias("reached"))
    reached = F.coalesce("reached", F.lit(False))
    return px.drop("bg").join(found, PIXEL, "left").withColumn("reached", reached).withColumn("bg", reached & (F.col("score") > background))


def frame_metrics(px: DataFrame, width: int) -> DataFrame:
    """Quality of a matte per frame: px is confident() of the source, with the output's alpha `a` and colours out_r, out_g, out_b. Without background or foreground pixels their errors are 1, without soft pixels the fringe is 0, without a visible component the fragments are 0."""
    a, bg, fg = F.col("a"), F.col("bg"), F.col("fg")
    soft = (a > 0.02) & (a < 0.98)
    green = F.greatest(F.lit(0.0), F.col("out_g") - (F.col("out_r") + F.col("out_b")) * 0.5)
    leak, loss = X.avg_where(a, bg, 1.0), X.avg_where(1 - a, fg, 1.0)
    found = px.groupBy(*FRAME).agg(
        ((leak + loss) * 0.5).alias("pseudo_mae"), leak.alias("background_alpha_mean"), loss.alias("foreground_loss_mean"), X.avg_where(green * a, soft, 0.0).alias("green_fringe"),
        (X.share((a > 0.50) & (F.col("score") > 0.25)) * 100).alias("opaque_green_leak_pct"), (X.share(soft) * 100).alias("soft_alpha_pct"), (X.share(a > 0.02) * 100).alias("coverage_pct"),
    )
    parts = fragments(px, a > 0.08, width)
    return found.join(parts, FRAME, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("fragment_pct", "fragment_count")})


def fragments(px: DataFrame, mask: Column, width: int, least: int = 4) -> DataFrame:
    """Per frame with a mask: the share of its pixels outside the largest component, and the components of `least` pixels or more besides one."""
    areas = labelled(px.where(mask), width).groupBy(*FRAME, "label").agg(F.count("*").alias("area"))
    all_ = F.sum("area")
    return areas.groupBy(*FRAME).agg(((all_ - F.max("area")) * 100.0 / all_).alias("fragment_pct"), (F.count_if(F.col("area") >= least) - 1).cast("double").alias("fragment_count"))


def _roots(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected components of pixels in order of y and x, over runs of each row: for each pixel its component's first pixel, and the pixels that start a run."""
    new = np.ones(len(y), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(y)))
    rows, first, last = y[start].tolist(), x[start].tolist(), x[start + size - 1].tolist()
    root = list(range(len(start)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    j = 0
    for i, row in enumerate(rows):
        while j < i and (rows[j] < row - 1 or (rows[j] == row - 1 and last[j] < first[i] - 1)):
            j += 1
        k = j
        while k < i and rows[k] == row - 1 and first[k] <= last[i] + 1:
            p, q = find(k), find(i)
            if p != q:
                root[max(p, q)] = min(p, q)
            k += 1
    return np.repeat(start[[find(i) for i in range(len(start))]], size), start


def _labels(width: int, height: int | None):
    """Labels of frames (clip, f, sorted places), many frames at once; with a height only components that touch the border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            flat, owner = places.flatten().to_numpy(), np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
            if not len(flat):
                continue
            y, x = flat // width, flat % width
            first, _ = _roots(owner * (int(y.max()) + 2) + y, x)  # no row of a frame is next to one of another
            keep = np.ones(len(flat), bool)
            if height is not None:
                edge = np.zeros(len(flat), bool)
                edge[first[(x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)]] = True
                keep = edge[first]
            of = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(v[keep].astype(np.int32)) for v in (y, x)), pa.array(flat[first][keep])], names=[*PIXEL, "label"])

    return run


def labelled(mask: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """(clip, f, y, x, label) of mask pixels; the label is a component's smallest y * width + x. A row of the shuffle is a frame. height: only components that touch the border."""
    kinds = dict(mask.dtypes)
    place = (F.col("y") * width + F.col("x")).cast("long")
    frames = mask.groupBy(*FRAME).agg(F.sort_array(F.collect_list(place)).alias("places"))
    return frames.mapInArrow(_labels(width, height), f"clip {kinds['clip']}, f {kinds['f']}, y int, x int, label long")


def components(mask: DataFrame, width: int) -> DataFrame:
    """A row for each component: area, box with exclusive ends, centre."""
    return labelled(mask, width).groupBy(*FRAME, "label").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def largest(parts: DataFrame) -> DataFrame:
    """The largest component of each frame, the smallest label on ties."""
    at = F.struct("area", -F.col("label"))
    return parts.groupBy(*FRAME).agg(F.max_by("label", at).alias("label"), F.max("area").alias("area"), F.count("*").alias("parts"))


def touching_border(marked: DataFrame, width: int, height: int) -> DataFrame:
    """Labelled pixels of components that touch the border."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    labels = marked.where(edge).select(*FRAME, "label").distinct()
    return marked.join(labels, [*FRAME, "label"], "left_semi")


def morphology(px: DataFrame, value: str, how: str, radius: int) -> DataFrame:
    """max, min or avg over a square window, one axis after the other; pixels out of frame don't count."""
    f = {"max": F.max, "min": F.min, "avg": F.avg}[how]
    rows = Window.partitionBy(*FRAME, "y").orderBy("x").rangeBetween(-radius, radius)
    columns = Window.partitionBy(*FRAME, "x").orderBy("y").rangeBetween(-radius, radius)
    return px.withColumn(value, f(value).over(rows)).withColumn(value, f(value).over(columns))


def matte_qa(px: DataFrame, samples: int = 6) -> DataFrame:
    """Per clip, over every max(1, n // samples)-th frame, at most `samples`: the worst share of green spill on the silhouette and in transitions among visible pixels (1 for an empty frame), and the visible share of the middle sample."""
    n = px.groupBy("clip").agg(F.count_distinct("f").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / samples))
    at = F.floor(F.col("f") / step)
    taken = px.join(n, "clip").where((F.col("f") % step == 0) & (at < samples)).withColumn("_i", at)
    seen = F.col("a") > 16 / 255
    core = morphology(taken.select(*PIXEL, seen.cast("int").alias("_core")), "_core", "min", 2)
    edge = seen & ((F.col("_core") == 0) | (F.col("a") < 245 / 255))
    green = (F.col("g") > F.col("r") + 24 / 255) & (F.col("g") > F.col("b") + 24 / 255)
    frame = taken.join(core, PIXEL).groupBy("clip", "_i").agg(F.coalesce(F.try_divide(F.count_if(edge & green), F.count_if(seen)), F.lit(1.0)).alias("_residual"), X.share(seen).alias("_visible"))
    clip = frame.groupBy("clip").agg(F.max("_residual").alias("residual"), F.collect_list(F.struct("_i", "_visible")).alias("_v"), F.count("*").alias("sampled"))  # at most `samples` entries
    middle = F.filter("_v", lambda v: v["_i"] == F.floor(F.col("sampled") / 2))[0]["_visible"]
    return clip.select("clip", "residual", middle.alias("mid_visible"), "sampled")


def plane_comparison(px: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Per clip the means over frames of: the mean absolute difference, the soft and hole shares of the reference's interior, and the share of its background that leaks; planes count in steps of 1 / 255."""
    p, r = X.quantise(F.col(value)), X.quantise(F.col("_r"))
    inside, outside = r >= 250, r <= 5
    both = px.join(reference.select(*PIXEL, F.col(value).alias("_r")), PIXEL)

    def part(hit: Column, of: Column) -> Column:
        return F.count_if(hit & of) / F.greatest(F.lit(1), F.count_if(of))

    frame = both.groupBy(*FRAME).agg(
        (F.avg(F.abs(p - r)) / 255).alias("alpha_mae"), part(p < 250, inside).alias("reference_interior_soft_fraction"),
        part(p < 128, inside).alias("reference_interior_hole_fraction"), part(p > 16, outside).alias("reference_background_leak_fraction"),
    )
    return frame.groupBy("clip").agg(*[F.avg(c).alias(c) for c in frame.columns if c not in FRAME])


def edge_luminance(px: DataFrame, edge: float = 4.0, inner: tuple[float, float] = (8.0, 18.0), radius: int = 18) -> DataFrame:
    """Per frame with visible pixels: mean luma at most `edge` from the outside and in the opaque band `inner` (the edge's where that is empty), their difference, and the share of the edge that is bright and neutral."""
    visible = F.col("a") > 0.04
    near = nearest(px, visible, ~visible, "a", radius).select(*PIXEL, F.coalesce("distance", F.lit(radius + 1.0)).alias("_d"))
    luma = F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722
    neutral = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    at_edge = F.col("_d") <= edge
    mean = X.avg_where(luma, at_edge, 0.0)
    inside = F.coalesce(X.avg_where(luma, F.col("_d").between(*inner) & (F.col("a") > 0.96)), mean)
    bright = F.count_if(at_edge & (luma > 0.82) & (neutral < 0.22)) * 100.0 / F.greatest(F.lit(1), F.count_if(at_edge))
    return px.join(near, PIXEL).groupBy(*FRAME).agg(mean.alias("edge_luma_mean"), inside.alias("inner_luma_mean"), (mean - inside).alias("edge_luma_excess"), bright.alias("bright_neutral_edge_pct"))


def box(px: DataFrame, inside: Column) -> DataFrame:
    """The box of the pixels inside, exclusive at the end; frames without any have no row."""
    return px.where(inside).groupBy(*FRAME).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def consecutive(px: DataFrame, value: str) -> DataFrame:
    """px plus the pixel's value in the frame before."""
    w = Window.partitionBy("clip", "y", "x").orderBy("f")
    return px.withColumn("prev", F.lag(value).over(w))


def clip_profile(px: DataFrame, border: Column, least_green: float = 0.45, quantile: float = 0.002, fail: float = 0.42) -> DataFrame:
    """Per clip, from the border of frames that are green enough there: a low quantile of the score (the key's floor), the median colour and a status."""
    band = with_score(px).where(border)
    green = band.groupBy(*FRAME).agg(X.share(F.col("score") > 0.10).alias("_green")).where(F.col("_green") >= least_green)
    used = band.join(green, FRAME)
    out = used.groupBy("clip").agg(
        F.least(F.lit(0.98), F.percentile("score", F.lit(quantile))).alias("bg_floor"), *[F.median(c).alias(f"key_{c}") for c in "rgb"], F.count_distinct("f").alias("sampled_frames")
    )
    return out.withColumn("status", F.when(F.col("bg_floor") < fail, "fail").otherwise("ok"))


def _nearest(radius: int):
    around = sorted((dy * dy + dx * dx, dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            fields = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]  # y, x, wanted, source, value
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i in range(len(batch)):
                y, x, wanted, source, value = (c[offsets[i] : offsets[i + 1]] for c in fields)
                y, x = y + radius, x + radius
                have, held = np.zeros((y.max() + radius + 1, x.max() + radius + 1), bool), np.zeros((y.max() + radius + 1, x.max() + radius + 1))
                have[y[source], x[source]], held[y[source], x[source]] = True, value[source]
                y, x = y[wanted], x[wanted]
                found, distance = np.full(len(y), np.nan), np.full(len(y), np.nan)
                left = np.arange(len(y))
                for d2, dy, dx in around:
                    hit = have[y[left] + dy, x[left] + dx]
                    at = left[hit]
                    found[at], distance[at] = held[y[at] + dy, x[at] + dx], np.sqrt(d2)
                    left = left[~hit]
                    if not len(left):
                        break
                n = pa.array(np.full(len(y), i))
                none = np.isnan(distance)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(n), batch.column(1).take(n), pa.array((y - radius).astype(np.int32)), pa.array((x - radius).astype(np.int32)), pa.array(found, mask=none), pa.array(distance, mask=none)], names=[*PIXEL, "value", "distance"])

    return run


def nearest(px: DataFrame, wanted: Column, source: Column, value: str, radius: int) -> DataFrame:
    """For each wanted pixel the value of the nearest source pixel at most `radius` away in y and x: of equally near ones the first by y, x. Unmatched: null. A row of the shuffle is a frame; its grid is searched offset by offset."""
    kinds = dict(px.dtypes)
    pixel = F.struct(F.col("y").cast("int"), F.col("x").cast("int"), F.coalesce(wanted, F.lit(False)), F.coalesce(source, F.lit(False)), F.col(value).cast("double"))
    frames = px.groupBy(*FRAME).agg(F.collect_list(pixel).alias("pixels"))
    return frames.mapInArrow(_nearest(radius), f"clip {kinds['clip']}, f {kinds['f']}, y int, x int, value double, distance double").withColumnRenamed("value", value)
