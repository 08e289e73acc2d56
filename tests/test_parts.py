"""Rules on connected parts on hand-made frames, and diagnostics against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.operators import diagnostics as D
from framewell.operators import parts as K
from framewell.operators import pixels as P

SIDE = 260


def components(spark, *boxes, clip="c"):
    """Components of a frame in which each box (y0, y1, x0, x1) is filled."""
    mask = np.zeros((SIDE, SIDE), bool)
    for y0, y1, x0, x1 in boxes:
        mask[y0:y1, x0:x1] = True
    rows = [(clip, 0, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)]
    return P.components(spark.createDataFrame(rows, "clip string, f int, y int, x int"), SIDE)


BODY = (100, 160, 100, 160)


def test_detached_parts(spark):
    parts = components(spark, BODY, (78, 84, 120, 126), (20, 30, 20, 30), (20, 38, 200, 218), (120, 125, 176, 180))
    assert [(r.area) for r in K.detached(parts).collect()] == [100], "near and large parts stay"
    assert K.detached(parts, large=0.02).count() == 0 and sorted(r.area for r in K.detached(parts, pad=(2, 0.0)).collect()) == [20, 36, 100]
    assert K.detached(components(spark, BODY)).count() == 0


def test_overlays(spark):
    subject = components(spark, BODY, (10, 14, 10, 140), (20, 40, 20, 60), (230, 232, 230, 232), (5, 255, 250, 253))
    white = components(spark, (10, 14, 10, 140), (20, 40, 20, 60), (120, 130, 120, 130), (230, 232, 230, 232), (5, 255, 250, 253))
    assert sorted((r.area, r.why) for r in K.overlays(white, subject).collect()) == [(520, "stroke"), (750, "stroke"), (800, "label")]
    assert K.overlays(white, components(spark, BODY)).count() == 0, "nothing but the subject"
    assert sorted(r.area for r in K.overlays(white, subject, label=(700, 700, 180)).collect()) == [520, 750]


def test_kept_box(spark):
    parts = components(spark, BODY, (90, 95, 120, 125), (10, 40, 10, 40), (250, 253, 250, 253))
    assert [tuple(r)[2:] for r in K.kept_box(parts, SIDE, SIDE).collect()] == [(0, 0, 174, 174)]
    assert [tuple(r)[2:] for r in K.kept_box(parts, SIDE, SIDE, large=0.5).collect()] == [(86, 76, 174, 174)]
    assert [tuple(r)[2:] for r in K.kept_box(components(spark, BODY), 165, 170).collect()] == [(86, 86, 165, 170)]


def stack(rng, n, h=6, w=7):
    return rng.choice([0, 10, 16, 128, 249, 250, 255], (n, h, w), p=[0.45, 0.05, 0.05, 0.1, 0.05, 0.1, 0.2])


def parts_of(mask):
    """Sizes and centres of the 8-connected parts, in order of their first pixel."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    for p in sorted(left):
        if p in left:
            left.discard(p)
            found, todo = [p], [p]
            while todo:
                y, x = todo.pop()
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if q in left:
                        left.discard(q), found.append(q), todo.append(q)
            out.append((len(found), *np.mean(found, 0)))
    return out


def test_diagnostics_against_numpy(spark):
    rng = np.random.default_rng(6)
    clips = {"a": stack(rng, 9), "b": stack(rng, 4), "one": stack(rng, 1), "none": np.zeros((3, 6, 7), int)}
    px = spark.createDataFrame([(c, f, y, x, int(v)) for c, s in clips.items() for f, p in enumerate(s) for y, row in enumerate(p) for x, v in enumerate(row)], "clip string, f int, y int, x int, q long")
    got = {r.clip: r for r in D.alpha_diagnostics(px, 7, 6).collect()}
    for c, s in clips.items():
        seen = s >= 16
        found = [parts_of(m) for m in seen]
        big = [max(p, key=lambda x: x[0]) for p in found if p]
        cover = seen.mean((1, 2))
        r = got[c]
        assert (r.alpha_unique_value_count, r.alpha_value_min, r.alpha_value_max) == (len(np.unique(s)), s.min(), s.max())
        assert (r.component_count_max, r.empty_frames) == (max(map(len, found)), (cover == 0).sum())
        assert r.edge_touch_frames == sum(m[0].any() or m[-1].any() or m[:, 0].any() or m[:, -1].any() for m in seen)
        assert [r.visible_coverage_mean, r.visible_coverage_cv, r.soft_alpha_coverage_mean] == pytest.approx([cover.mean(), cover.std() / cover.mean() if cover.mean() and len(s) > 1 else 0, ((s > 0) & (s < 250)).mean()])
        assert [r.centroid_span_y, r.centroid_span_x] == pytest.approx([np.ptp([b[k] for b in big]) if big else 0 for k in (1, 2)])
        steps = [abs(a - b).mean() / 255 for a, b in zip(s[1:], s[:-1], strict=True)]
        assert r.consecutive_alpha_mae_p95 == (pytest.approx(np.percentile(steps, 95)) if steps else None)

    masks = px.select(*P.PIXEL, (F.col("q") > 100).alias("m"), F.greatest(F.lit(0), F.col("q") - F.col("x") * 3).alias("q"), (F.col("q") > 20).alias("r"))
    found = {r.clip: r for r in D.mask_diagnostics(masks, 7).collect()}
    for c, s in clips.items():
        m, ref, q = s > 100, s > 20, np.maximum(0, s - 3 * np.arange(7))
        iou = lambda a, b: (a & b).sum() / (a | b).sum() if (a | b).any() else 1.0
        soft = (q > 8) & (q < 247)
        r = found[c]
        assert r.reference_iou_p05 == pytest.approx(np.percentile([iou(a, b) for a, b in zip(m, ref, strict=True)], 5))
        assert r.soft_band_containment_mean == pytest.approx(np.mean([a[b].mean() if b.any() else 1.0 for a, b in zip(m, soft, strict=True)]))
        assert r.interior_hole_fraction == pytest.approx(np.mean([(~a & (b >= 250)).sum() / max(1, (b >= 250).sum()) for a, b in zip(m, q, strict=True)]))
        assert r.background_leak_fraction == pytest.approx(np.mean([(a & (b <= 5)).sum() / max(1, (b <= 5).sum()) for a, b in zip(m, q, strict=True)]))
        assert r.reference_area_mae == pytest.approx(abs(m.mean((1, 2)) - ref.mean((1, 2))).mean()) and r.reference_alpha_mae == pytest.approx(abs(m - q / 255).mean())
        assert r.consecutive_mask_iou_mean == (pytest.approx(np.mean([iou(a, b) for a, b in zip(m[1:], m[:-1], strict=True)])) if len(s) > 1 else None)
        assert r.reference_iou_trend == (pytest.approx(np.polyfit(range(len(s)), [iou(a, b) for a, b in zip(m, ref, strict=True)], 1)[0], abs=1e-9) if len(s) > 1 else None)
        assert r.component_count_max == max(len(parts_of(a)) for a in m)


def test_temporal_gate(spark):
    rows = [(c, f, 0, x, float(f % 2)) for c in ("even", "named", "one") for f in range(1 if c == "one" else 4) for x in range(3)]
    px = spark.createDataFrame(rows, "clip string, f int, y int, x int, a double")
    names = px.select("clip", "f").distinct().withColumn("name", F.when(F.expr("clip = 'named' and f = 2"), "cover.png").otherwise(F.concat(F.lit("f_"), F.col("f").cast("string"), F.lit(".png"))))
    assert {r.clip: r[1] for r in D.temporal_alpha(px, names).collect()} == {"even": 1.0, "named": None, "one": None}
    with pytest.raises(Exception, match="different sizes in clip even"):
        D.temporal_alpha(px.where("not (clip = 'even' and f = 2 and x = 2)"), names).collect()


def test_geometry_and_union(spark):
    rows = []
    for f, (body, source) in enumerate([((3, 9), (3, 9)), ((0, 5), (2, 9)), (None, (4, 6)), ((4, 8), None)]):
        for y in range(12):
            for x in range(12):
                at = lambda box: box is not None and box[0] <= x < box[1] and 4 <= y < 8  # noqa: B023, E731
                rows.append(("c", f, y, x, 0.5 if at(body) else 0.0, at(source)))
    px = spark.createDataFrame(rows, "clip string, f int, y int, x int, a double, s boolean")
    r = D.geometry(px, 12, 12, edge=1).first()
    assert (r.border_touch_frames, r.source_border_risk_frames, r.min_subject_clearance_px) == (2, 0, 0) and r.mean_subject_clearance_px == pytest.approx((3 + 0 + 0 + 4) / 4)
    assert r.subject_coverage_pct == pytest.approx((24 + 20 + 16) / 3 / 144 * 100)
    assert r.lateral_alpha_retention == pytest.approx((0.5 + 0.5 + 0 + 0) / 4) and r.lateral_main_component_ratio == pytest.approx((1 + 1 + 0 + 0) / 4)
    assert tuple(D.union_box(px, F.col("a") > 0, 12, 12, 3).first()) == ("c", 0, 4, 9, 8, True, False, True, False)
