"""Extension points: providers that turn frames into mattes, and named metrics."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.operators import ranks

#: Frames of a clip that a provider with Stretches gets at once, besides their neighbours.
STRETCH = 64


@dataclass(frozen=True)
class Stretches:
    """As run.stretches, says that a provider can do a clip in stretches: run(frames, known) gets STRETCH frames in order of their names and the one before and after, and what `known` made of every max(1, n // samples)-th frame of the clip."""

    samples: int
    known: Callable[[pd.DataFrame], object]


PROVIDERS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}
METRICS: dict[str, Callable[[], Column]] = {}


def register_provider(name: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """run: a clip's frames (clip, name, width, height, n_channels, data) to as many RGBA frames of the same names and sizes; a column `error` may tell of frames that it could not do."""
    PROVIDERS[name] = run


def register_metric(name: str, build: Callable[[], Column]) -> None:
    """build: an aggregate expression over pixel rows."""
    METRICS[name] = build


def run_provider(name: str, frames: DataFrame) -> DataFrame:
    """(clip, name, width, height, n_channels, data, error): each clip goes to the provider, in stretches if it can do them; names or sizes that don't match are errors in the rows, not failures."""
    provider = PROVIDERS[name]
    columns = ["clip", "name", "width", "height", "n_channels", "data"]

    def run(pdf: pd.DataFrame, *known) -> pd.DataFrame:
        pdf = pdf.sort_values("name", kind="stable")
        out = provider(pdf.copy(), *known)
        out = out[columns].assign(error=out["error"] if "error" in out else None)
        sizes = {r.name: (r.width, r.height) for r in pdf.itertuples()}
        if set(out["name"]) != set(sizes) or len(out) != len(pdf):
            out["error"] = "names differ from the source"
        else:
            bad = [(r.width, r.height) != sizes[r.name] or r.n_channels != 4 for r in out.itertuples()]
            out.loc[bad, "error"] = "not RGBA of the source's size"
        return out

    schema = "clip string, name string, width int, height int, n_channels int, data binary, error string"
    if (by := getattr(provider, "stretches", None)) is None:
        return frames.select(*columns).groupBy("clip").applyInPandas(run, schema)

    at = ranks.placed(frames.select(*columns), ["clip", "name"], "_at")
    clips = at.groupBy("clip").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    rows = _of_clip(at, clips).withColumn("_at", F.col("_at") - F.col("_first"))

    def known(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"clip": [pdf["clip"].iloc[0]], "_known": [pickle.dumps(by.known(pdf.sort_values("_at")))]})

    facts = rows.where(F.col("_at") % F.greatest(F.lit(1), F.floor(F.col("_n") / by.samples)) == 0).groupBy("clip").applyInPandas(known, "clip string, _known binary")
    own = F.floor(F.col("_at") / STRETCH)
    dealt = F.explode(F.array_compact(F.array(own, F.when(F.col("_at") % STRETCH == 0, own - 1), F.when(F.col("_at") % STRETCH == STRETCH - 1, own + 1))))

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        mine = (pdf["_at"] // STRETCH == pdf["_stretch"]).to_numpy()
        if not mine.any():  # the neighbour of a stretch that isn't there
            return pd.DataFrame(columns=[*columns, "error"])
        out = run(pdf[columns], pickle.loads(pdf["_known"].iloc[0]))
        return out[mine] if len(out) == len(mine) else out[out["name"].isin(pdf["name"][mine])]

    return _of_clip(rows.select(*columns, "_at", dealt.alias("_stretch")), facts).groupBy("clip", "_stretch").applyInPandas(stretch, schema)


def _of_clip(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """rows beside their clip's row of clips; a null clip is one as well."""
    return rows.join(clips.withColumnRenamed("clip", "_clip"), F.col("clip").eqNullSafe(F.col("_clip"))).drop("_clip")


def extra_metrics(px: DataFrame) -> DataFrame:
    """Registered metrics of each frame."""
    return px.groupBy("clip", "f").agg(*[build().alias(name) for name, build in METRICS.items()]) if METRICS else px.select("clip", "f").distinct()


register_metric("mean_alpha", lambda: F.avg("a"))
