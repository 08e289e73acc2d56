"""From frames to a provider's mattes and on to their metrics; the adaptive key is built in as a provider."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.functions import plugins
from framewell.operators import matte as M
from framewell.operators import pixels as P
from framewell.operators.stages import kept

#: Frames of a clip that its profile is taken from: up to twice as many less one.
SAMPLES = 12


def planes_of(data: bytes, height: int, width: int, channels: int) -> list[np.ndarray]:
    """r, g, b in 0..1 of bytes in the order blue, green, red."""
    v = np.frombuffer(data, np.uint8).reshape(height, width, channels) / 255.0
    return [v[:, :, k] for k in (2, 1, 0)]


def profile_of(shots: list[list[np.ndarray]], samples: int = SAMPLES, band: int | None = None, least: float = 0.45, quantile: float = 0.002, fail: float = 0.42) -> tuple[float, list[float]] | None:
    """The floor and the key colour of a clip's frames, None without a reliable screen: what matte.clip_profile() says."""
    scores, colours = [], []
    for planes in shots[:: max(1, len(shots) // samples)]:
        score, edge = M.green_score(*planes), M.border_band(*planes[0].shape, band)
        green = edge & (score > 0.30) & (planes[1] > 0.14)
        if green.sum() >= edge.sum() * least:
            scores.append(score[green])
            colours.append(np.stack([p[green] for p in planes]))
    if not scores or (floor := np.quantile(np.concatenate(scores), quantile)) < fail:
        return None
    return min(0.98, float(floor)), np.median(np.concatenate(colours, 1), 1).tolist()


def adaptive_key(rules: M.KeyRules = M.KeyRules(), threshold: float = 10 / 255, grow: int = 4):
    """A provider: a clip's frames keyed by the clip's profile and their motion. A clip without a reliable screen comes back opaque, with an error. As the provider's Stretches it can be given a stretch of a clip, with the profile from the clip's samples."""

    def planes_in(pdf: pd.DataFrame) -> list[list[np.ndarray]]:
        return [planes_of(r.data, r.height, r.width, r.n_channels) for r in pdf.itertuples()]

    def run(pdf: pd.DataFrame, known=None) -> pd.DataFrame:
        shots = planes_in(pdf)
        profile, out = known[0] if known else profile_of(shots, band=rules.band), []
        for i, planes in enumerate(shots):
            if profile is None:
                made = [np.ones_like(planes[0]), *planes]
            else:
                moved = np.zeros(planes[0].shape)
                for other in (shots[j] for j in (i - 1, i + 1) if 0 <= j < len(shots)):
                    moved = np.maximum(moved, sum(abs(p - q) for p, q in zip(planes, other, strict=True)) / 3)
                made = M.key_frame(*planes, *profile, M.grown(moved > threshold, grow), rules)
            alpha, r, g, b = made
            out.append((np.round(np.stack([b, g, r, alpha], -1) * 255, 6) + 0.5).astype(np.uint8).tobytes())  # halves go up, whatever their last bits
        return pdf.assign(data=out, n_channels=4, error=None if profile is not None else "no reliable green screen")

    # in a tuple, since a profile can be None
    run.stretches = plugins.Stretches(SAMPLES, lambda pdf: (profile_of(planes_in(pdf), band=rules.band),))
    return run


plugins.register_provider("adaptive_key", adaptive_key())


def evaluated(frames: DataFrame, provider: str, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(a row of metrics for each frame, the rows of errors): frames (clip, name, width, height, n_channels, data) go to the provider, its mattes back to pixels, and those beside their source to frame_metrics and the registered metrics. Frames of an error have no metrics."""
    frames = kept(frames, "frames")
    made = kept(plugins.run_provider(provider, frames), "mattes")
    mattes = made.where("error is null").select("clip", "name", F.col("data").alias("_made"))
    px = P.confident(_beside(frames.join(mattes, ["clip", "name"])), width, height)
    metrics = P.frame_metrics(px, width).join(plugins.extra_metrics(px), P.FRAME)
    return metrics.withColumnRenamed("f", "name"), made.where("error is not null").select("clip", "name", "error")


def _beside(both: DataFrame) -> DataFrame:
    """(clip, f, y, x, r, g, b, out_r, out_g, out_b, a): pixels of the frames `data` beside those of their mattes `_made`, of the same size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clip, name, width, channels, data, made = (batch.column(i) for i in range(6))
            pixels = [len(v.as_buffer()) // 4 for v in made]
            for i, j in M._runs(np.array(pixels)):
                n = np.array(pixels[i:j])
                of = pa.array(np.repeat(np.arange(i, j), n))
                at = np.concatenate([np.arange(k) for k in n])
                wide = np.repeat(width.to_numpy()[i:j], n)
                source = np.concatenate([np.frombuffer(data[k].as_buffer(), np.uint8).reshape(-1, channels[k].as_py())[:, :3] for k in range(i, j)]) / 255.0
                out = np.concatenate([np.frombuffer(made[k].as_buffer(), np.uint8).reshape(-1, 4) for k in range(i, j)]) / 255.0
                planes = [*(source[:, k] for k in (2, 1, 0)), *(out[:, k] for k in (2, 1, 0, 3))]
                yield pa.RecordBatch.from_arrays([clip.take(of), name.take(of), *(pa.array(v.astype(np.int32)) for v in (at // wide, at % wide)), *(pa.array(np.ascontiguousarray(v)) for v in planes)], names=[*P.PIXEL, *"rgb", "out_r", "out_g", "out_b", "a"])

    rows = both.where("n_channels in (3, 4)").select("clip", "name", "width", "n_channels", "data", "_made")
    return rows.mapInArrow(run, "clip string, f string, y int, x int, r double, g double, b double, out_r double, out_g double, out_b double, a double")
