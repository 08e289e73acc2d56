"""Which connected parts of a frame stay: three sets of rules over tables of components (label, area, box with exclusive ends)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.operators.pixels import FRAME, largest

BOX = ("x0", "y0", "x1", "y1")


def with_main(parts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """parts plus the label, area and box (m_...) of the frame's largest part of `of`, by default of its own; frames without one have no row."""
    of = parts if of is None else of
    main = of.join(largest(of).select(*FRAME, "label"), [*FRAME, "label"], "left_semi").select(*FRAME, *[F.col(c).alias(f"m_{c}") for c in ("label", "area", *BOX)])
    return parts.join(main, FRAME)


def padding(least: int, share: float) -> Column:
    """Pixels around the main box: a share of its longer side, cut to a whole number, `least` at least."""
    return F.greatest(F.lit(least), F.floor(F.greatest(F.col("m_x1") - F.col("m_x0"), F.col("m_y1") - F.col("m_y0")) * share))


def overlaps(pad: Column) -> Column:
    """The part's box and the padded main box meet; boxes that share an edge do."""
    return (F.col("x1") >= F.col("m_x0") - pad) & (F.col("x0") <= F.col("m_x1") + pad) & (F.col("y1") >= F.col("m_y0") - pad) & (F.col("y0") <= F.col("m_y1") + pad)


def detached(parts: DataFrame, pad: tuple[int, float] = (16, 0.025), large: float = 0.08) -> DataFrame:
    """Parts to remove: not the main one, away from it, and smaller than a share of it."""
    rows = with_main(parts).where("label <> m_label")
    return rows.where(~overlaps(padding(*pad)) & (F.col("area") < F.col("m_area") * large)).select(*FRAME, "label", "area")


def overlays(white: DataFrame, subject: DataFrame, pad: tuple[int, float] = (12, 0.025), least: int = 12, stroke: tuple[int, int] = (120, 6), label: tuple[int, int, int] = (18_000, 700, 180)) -> DataFrame:
    """White parts to remove, away from the subject's main part: thin strokes (longer than, at most so thick) and label-like ones (smaller in area, width and height), of `least` pixels at least. Adds why. Frames of which all but the background is one part keep theirs."""
    several = subject.groupBy(*FRAME).agg(F.count("*").alias("n")).where("n > 1").select(*FRAME)
    rows = with_main(white, subject).join(several, FRAME, "left_semi").where((F.col("area") >= least) & ~overlaps(padding(*pad)))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    thin = ((w > stroke[0]) & (h <= stroke[1])) | ((h > stroke[0]) & (w <= stroke[1]))
    small = (F.col("area") < label[0]) & (w < label[1]) & (h < label[2])
    return rows.withColumn("why", F.when(thin, "stroke").when(small, "label")).where("why is not null").select(*FRAME, "label", "area", "why")


def kept_box(parts: DataFrame, width: int, height: int, near: tuple[int, float] = (8, 0.01), large: float = 0.03, pad: tuple[int, float] = (14, 0.015)) -> DataFrame:
    """(clip, f, x0, y0, x1, y1): the box around the main part and those near it or large by a share of it, padded and cut to the frame; all outside is background."""
    rows = with_main(parts).where((F.col("label") == F.col("m_label")) | overlaps(padding(*near)) | (F.col("area") >= F.col("m_area") * large))
    around = F.first(padding(*pad))
    return rows.groupBy(*FRAME).agg(
        F.greatest(F.lit(0), F.min("x0") - around).cast("int").alias("x0"), F.greatest(F.lit(0), F.min("y0") - around).cast("int").alias("y0"),
        F.least(F.lit(width), F.max("x1") + around).cast("int").alias("x1"), F.least(F.lit(height), F.max("y1") + around).cast("int").alias("y1"),
    )
