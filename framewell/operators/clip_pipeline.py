"""From the frames of all clips to one row of metrics for each: profile, motion, key, quality ladder, loop decision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.functions import exprs as X
from framewell.operators import clip as C
from framewell.operators import matte as M
from framewell.operators.stages import kept


@dataclass(frozen=True)
class Ladder:
    """The attempts of a clip, in order: the adaptive key, then chroma keys of rising similarity."""

    similarities: Sequence[float] = (0.10, 0.14, 0.18)
    blend: float = 0.06
    least_visible: float = 0.04
    most_green: float = 0.015


@dataclass(frozen=True)
class Loop:
    """How a clip is closed: locked clips stay as they are; optimised ones take their best span, which closes directly up to the seam `direct`; others are trimmed, and their last `close` frames blended into the first."""

    direct: float = 0.012
    start_below: int = 24
    least: int = 72
    trim: int = 6
    keep: int = 24
    close: int = 8


def attempts(frames: DataFrame, profile: DataFrame, rules: M.KeyRules = M.KeyRules(), ladder: Ladder = Ladder(), band: int = 10) -> DataFrame:
    """(clip, attempt, similarity, visible, residual): a row for each attempt that a clip may need, from its sampled frames; attempt 0 is the adaptive key, and the others are only made for clips that it fails."""

    def judged(rows: DataFrame) -> DataFrame:
        at_middle = F.max(F.when(F.col("place") == F.col("middle"), F.col("visible")))
        return rows.groupBy("clip", "attempt", "similarity").agg(F.max("residual").alias("residual"), at_middle.alias("visible"))

    keyed = M.adaptive_matte(M.sampled(frames), profile, rules)
    first = judged(M.quality(keyed).select("*", F.lit(0).alias("attempt"), F.lit(None).cast("double").alias("similarity")))
    failed = first.where(F.coalesce(F.col("visible") < ladder.least_visible, F.lit(True))).select("clip")
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(float(s)).alias("similarity")) for i, s in enumerate(ladder.similarities)]))
    again = M.sampled(frames.drop("motion").join(failed, "clip", "left_semi")).join(M.key_colour(frames, band=band), "clip").select("*", steps.alias("step")).select("*", "step.*").drop("step")
    again = M.chroma_key(again, [F.col(f"key_{c}") for c in M.PLANES], F.col("similarity"), ladder.blend)
    return first.unionByName(judged(M.quality(again.drop("key_r", "key_g", "key_b"), silhouette=False)))


def outcome(tried: DataFrame, ladder: Ladder = Ladder()) -> DataFrame:
    """(clip, status, attempt, similarity, visible, residual): each clip's attempts folded in order.

    Status ok: the adaptive key shows enough of the subject. Else the first chroma key with little green is the
    fallback; if none has, the last is kept for review. A chroma key that shows too little ends the ladder: failed.
    """
    row = "struct<status: string, attempt: int, similarity: double, visible: double, residual: double>"
    ordered = F.array_sort(F.collect_list(F.struct("attempt", "similarity", "visible", "residual")))  # one for each step

    def status(t: Column) -> Column:
        shown = F.coalesce(t["visible"] >= ladder.least_visible, F.lit(False))
        return F.when(t["attempt"] == 0, F.when(shown, "ok").otherwise("next")).when(~shown, "failed").when(t["residual"] < ladder.most_green, "fallback").otherwise("review")

    def step(state: Column, t: Column) -> Column:
        now = F.struct(status(t).alias("status"), t["attempt"].alias("attempt"), t["similarity"].alias("similarity"), t["visible"].alias("visible"), t["residual"].alias("residual"))
        return F.when(state["status"].isin("ok", "failed", "fallback"), state).otherwise(now.cast(row))

    none = F.struct(F.lit("next").alias("status"), F.lit(0).alias("attempt"), *[F.lit(None).cast("double").alias(c) for c in ("similarity", "visible", "residual")]).cast(row)
    return tried.groupBy("clip").agg(ordered.alias("tried")).select("clip", F.aggregate("tried", none, step).alias("o")).select("clip", "o.*")


def signatures(keyed: DataFrame, cells: int = 48) -> DataFrame:
    """(clip, f, e): each frame's premultiplied colours and alpha, as means over `cells` x `cells` cells (pixels where the frame is smaller); frames are not shuffled."""
    kinds = dict(keyed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [M._planes(batch, c) for c in ("alpha", *M.PLANES)]
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            out = []
            for i, (height, width) in enumerate(sizes):
                a, *colours = (v[o[i] : o[i + 1]] for v, o in planes)
                side, at = min(cells, height, width), np.arange(height * width)
                cell = (at // width * side // height) * side + at % width * side // width
                n = np.bincount(cell)
                sums = np.stack([np.bincount(cell, v) for v in (*(c * a for c in colours), a)], 1)
                out.append((sums / n[:, None]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["clip", "f", "e"])

    rows = keyed.where("alpha is not null").select("clip", "f", "height", "width", "alpha", *M.PLANES)
    return rows.mapInArrow(run, f"clip {kinds['clip']}, f {kinds['f']}, e array<double>")


def loops(marks: DataFrame, kinds: DataFrame, loop: Loop = Loop()) -> DataFrame:
    """(clip, frames, mode, seam, closure, start, end, closed, out_frames): how each clip becomes a loop.

    marks: signatures(). kinds: (clip, kind) with locked, optimised, still (never blended) or plain; a clip without a row is
    plain. closed counts the frames that are blended, out_frames those that are left.
    """
    ends = C.seam(marks, loop.direct).select("clip", "seam")
    clips = marks.groupBy("clip").agg(F.count("*").cast("int").alias("frames")).join(ends, "clip").join(kinds, "clip", "left").withColumn("kind", F.coalesce("kind", F.lit("plain")))
    found = C.best_span(marks.join(clips.where("kind = 'optimised'"), "clip", "left_semi"), loop.start_below, loop.least)
    spans = found.select("clip", F.col("mode").alias("span_mode"), "start", "end")
    at_start = marks.select("clip", F.col("f").alias("start"), F.col("e").alias("_s"))
    at_end = marks.select("clip", F.col("f").alias("end"), F.col("e").alias("_e"))
    spans = spans.join(at_start, ["clip", "start"], "left").join(at_end, ["clip", "end"], "left").select("clip", "span_mode", "start", "end", X.l1_mean(F.col("_s"), F.col("_e")).alias("span_seam"))
    rows = clips.join(spans, "clip", "left")
    locked, spanned = (F.col("kind") == "locked") & (F.col("frames") >= 2), F.coalesce(F.col("span_mode") == "best_span", F.lit(False))
    direct = spanned & (F.col("span_seam") <= loop.direct)
    selected = F.when(spanned, F.col("end") - F.col("start") + 1).otherwise(F.col("frames"))
    cut = F.least(F.lit(loop.trim), F.floor(selected / 5))
    trimmed = F.when(selected - 2 * cut >= loop.keep, selected - 2 * cut).otherwise(selected)
    closed = F.when(locked | direct | (selected < 2) | (F.col("kind") == "still"), 0).otherwise(F.least(F.lit(loop.close), F.floor(trimmed / 5)))
    mode = F.when(locked, "locked_endpoints").when(F.col("span_mode").isNotNull(), F.col("span_mode")).otherwise("plain")
    closure = F.when(locked, "locked").when(direct, "direct").when(closed > 0, "crossfade").otherwise("none")
    left = F.when(locked | (selected < 2), F.col("frames")).when(direct, selected).otherwise(trimmed - closed)
    return rows.select("clip", "frames", mode.alias("mode"), F.when(spanned & ~locked, F.col("span_seam")).otherwise(F.col("seam")).alias("seam"), closure.alias("closure"), "start", "end", closed.cast("int").alias("closed"), left.cast("int").alias("out_frames"))


def clip_pipeline(frames: DataFrame, kinds: DataFrame, rules: M.KeyRules = M.KeyRules(), ladder: Ladder = Ladder(), loop: Loop = Loop(), motion: tuple[float, int] = (10 / 255, 4), band: int = 10) -> DataFrame:
    """A row of metrics for each clip of frames (clip, f from 0, height, width, r, g, b), all clips together: the frames with their motion, what is known of clips, and the signatures are written between the steps, since several of them read each.

    (clip, status, attempt, similarity, visible, residual, bg_floor, key_colour, frames, mode, seam, closure, start, end,
    closed, out_frames). Clips that fail have no loop: their columns from `mode` on are null.
    """
    moving = kept(M.with_motion(frames, *motion), "moving")
    frames = moving.drop("motion")
    profile = kept(M.clip_profile(frames, band=rules.band), "profile")
    done = kept(outcome(attempts(moving, profile, rules, ladder, band), ladder), "outcome")
    colours = kept(M.key_colour(frames, band=band), "colours")
    adaptive = M.adaptive_matte(moving.join(done.where("status = 'ok'"), "clip", "left_semi"), profile, rules).select("clip", "f", "height", "width", "alpha", *M.PLANES)
    second = done.where("status in ('fallback', 'review')").select("clip", F.col("similarity").alias("_similarity"))
    again = M.chroma_key(frames.join(second, "clip").join(colours, "clip"), [F.col(f"key_{c}") for c in M.PLANES], F.col("_similarity"), ladder.blend)
    chosen = adaptive.unionByName(again.select("clip", "f", "height", "width", "alpha", *M.PLANES))
    looped = loops(kept(signatures(chosen), "signatures"), kinds, loop).drop("frames")
    by_profile = profile.select("clip", "bg_floor", *[F.col(f"key_{c}").alias(f"_{c}") for c in M.PLANES])
    size = frames.groupBy("clip").agg(F.count("*").cast("int").alias("frames"))
    rows = done.join(size, "clip").join(by_profile, "clip", "left").join(colours, "clip", "left").join(looped, "clip", "left")
    ok = F.col("status") == "ok"
    shade = X.hex_colour(*[F.when(ok, F.col(f"_{c}")).otherwise(F.col(f"key_{c}")) for c in M.PLANES])
    return rows.select("clip", "status", "attempt", "similarity", "visible", "residual", "bg_floor", shade.alias("key_colour"), "frames", "mode", "seam", "closure", "start", "end", "closed", "out_frames")
