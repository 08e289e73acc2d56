"""Keying of hand-made frames, rule by rule, and the clip pipeline's ladder and loops."""

import dataclasses

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewell.operators import clip_pipeline as L
from framewell.operators import matte as M
from framewell.plans.pixel_queries import A1

KEY = (0.05, 0.90, 0.06)
FUR = (0.60, 0.52, 0.40)


def shot(size=96):
    """A disc of fur before a green screen: planes and the distance to the centre."""
    y, x = np.mgrid[:size, :size]
    d = np.hypot(y - size / 2, x - size / 2)
    body = d < size / 3
    return [np.where(body, f, k) for f, k in zip(FUR, KEY, strict=True)], d


def painted(planes, where, colour):
    return [np.where(where, c, p) for c, p in zip(colour, planes, strict=True)]


def box(size, y0, y1, x0, x1):
    out = np.zeros((size, size), bool)
    out[y0:y1, x0:x1] = True
    return out


def keyed(planes, motion=None, **rules):
    return M.key_frame(*planes, 0.9, KEY, motion, dataclasses.replace(M.KeyRules(), **rules))


def test_body_stays_and_screen_goes():
    planes, d = shot()
    alpha, *colour = keyed(planes)
    assert (alpha[d < 31] == 1).all() and (alpha[d > 33] == 0).all()
    assert all((c[alpha == 0] == 0).all() for c in colour)


def test_shadow_on_the_screen_goes():
    planes, d = shot()
    shadow = box(96, 84, 92, 20, 70) & (d > 33)
    assert (keyed(painted(planes, shadow, (0.02, 0.30, 0.02)))[0][shadow] == 0).all()


def test_gap_rule():
    planes, _ = shot()
    low, high, wide = box(96, 60, 70, 44, 50), box(96, 22, 30, 44, 50), box(96, 42, 72, 30, 62)
    assert (keyed(painted(planes, low, KEY))[0][low] == 0).all()
    assert (keyed(painted(planes, low, KEY), gap_area=(0, 0))[0][low] == 1).all()
    assert (keyed(painted(planes, high, KEY))[0][high] == 1).all(), "green high on the body belongs to it"
    assert (keyed(painted(planes, wide, KEY))[0][wide] == 1).all(), "too large for a gap"
    pale = painted(planes, low, (0.55, 0.60, 0.50))
    assert (keyed(pale)[0][low] == 1).all(), "hardly green"


def test_gap_at_its_limit():
    """A gap whose mean row is 0.4 of the height, 4.8 of 12, is low enough."""
    gap = box(12, 5, 6, 4, 8) | box(12, 4, 5, 5, 6)
    planes = painted(painted([np.full((12, 12), k) for k in KEY], box(12, 2, 10, 2, 10), FUR), gap, KEY)
    assert (keyed(planes, margin=1, band=2, gap_area=(1, 0.08))[0][gap] == 0).all()


def test_lift_rule():
    planes, d = shot()
    ring = (d >= 32) & (d < 35)
    smear = painted(planes, ring, [0.5 * f + 0.5 * k for f, k in zip((0.15, 0.12, 0.10), KEY, strict=True)])
    still, moving, off = keyed(smear)[0], keyed(smear, ring)[0], keyed(smear, ring, lift=False)[0]
    assert (moving[ring] > still[ring] + 0.2).all() and np.allclose(moving[ring], 0.47, atol=0.06)
    assert (still == off).all() and (moving[~ring] == still[~ring]).all()


def test_lift_at_its_limit():
    """A pixel that the means around it put at the limit, but for the last bits, is lifted as in SQL."""
    rng, rules, limits = np.random.default_rng(4), M.KeyRules(margin=0, band=2, window=5, despill=0, support=None), 0
    for _ in range(40):
        excess = rng.choice([90, 100, 110], (12, 12))
        body, doubt = box(12, 6, 12, 3, 9), box(12, 5, 6, 3, 9)
        excess[doubt] = 95
        base = np.where(doubt, 25, 20)
        planes = painted([base / 255, (base + excess) / 255, base / 255], body, (160 / 255, 140 / 255, 110 / 255))
        exc, sure = planes[1] - np.maximum(planes[0], planes[2]), ~body & ~doubt
        px = pd.DataFrame({"y": np.repeat(range(12), 12), "x": np.tile(range(12), 12), "e": np.where(sure, exc, 0.0).ravel(), "s": sure.ravel().astype(int)})
        mean = "avg({}) over (partition by {} order by {} range between 2 preceding and 2 following)"
        rows = duckdb.from_df(px).query("px", f"with a as (select y, x, {mean.format('e', 'y', 'x')} as e, {mean.format('s', 'y', 'x')} as s from px) select {mean.format('e', 'x', 'y')} as e, {mean.format('s', 'x', 'y')} as s from a order by y, x").df()
        cover = 1 - exc / (rows.e / rows.s).to_numpy().reshape(12, 12)
        limits += (abs(cover[doubt] - 0.05) < 1e-12).sum()
        alpha = M.key_frame(*planes, 0.8, KEY, np.ones((12, 12), bool), rules)[0]
        assert ((alpha[doubt] > 0) == (cover[doubt] > 0.05)).all()
    assert limits > 20


def test_despill_rule():
    planes, d = shot()
    cast, eye = box(96, 46, 50, 18, 22), box(96, 40, 46, 60, 66)
    planes = painted(painted(planes, cast, (0.50, 0.52, 0.44)), eye, (0.30, 0.60, 0.25))
    on, off = keyed(planes), keyed(planes, despill=0)
    assert (on[2][cast] < off[2][cast] - 0.02).all() and (on[3][cast] > off[3][cast]).all()
    assert (on[2][eye] == off[2][eye]).all(), "strong green stays"
    assert (keyed(planes, despill_radius=3.0)[2][cast & (d < 27)] == off[2][cast & (d < 27)]).all(), "far from the silhouette"


def test_support_rule():
    planes, _ = shot()
    far, near, dot = box(96, 5, 12, 5, 12), box(96, 11, 14, 46, 52), box(96, 9, 10, 60, 61)
    planes = painted(painted(painted(planes, far, FUR), near, FUR), dot, FUR)
    on, off = keyed(planes)[0], keyed(planes, support=None)[0]
    assert (on[far] == 0).all() and (off[far] == 1).all()
    assert (on[near] == 1).all() and (on[dot] == 0).all() and (off[dot] == 0).all()


def test_margin_and_soft_edge():
    planes, d = shot()
    assert (keyed([np.full((96, 96), f) for f in FUR])[0][M.border_band(96, 96, 2)] == 0).all()
    ring = (d >= 32) & (d < 33)
    alpha, _, g, _ = keyed(painted(planes, ring, [0.7 * f + 0.3 * k for f, k in zip(FUR, KEY, strict=True)]))
    assert ((alpha[ring] > 0.3) & (alpha[ring] < 1)).all() and (g[ring] < 0.6).all(), "soft pixels lose the green"


def test_nearest_and_boxes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        h, w = rng.integers(1, 9, 2)
        source, wanted, values = rng.random((h, w)) < 0.3, rng.random((h, w)) < 0.5, rng.random((h, w))
        for size in (1, 3, 5):
            want = [[values[max(0, y - size // 2) : y + size // 2 + 1, max(0, x - size // 2) : x + size // 2 + 1].sum() for x in range(w)] for y in range(h)]
            assert np.allclose(M.box_sum(values, size), want)
        if source.any():
            ys, xs = np.nonzero(source)
            want = [min(((a - p) ** 2 + (b - q) ** 2, p, q) for p, q in zip(ys, xs, strict=True)) for a, b in zip(*np.nonzero(wanted), strict=True)]
            assert [(d, y, x) for y, x, d in zip(*M.nearest(source, wanted), strict=True)] == want


def frames(spark, clips):
    """clips: name -> list of (r, g, b) planes."""
    rows = [(c, f, int(p[0].shape[0]), int(p[0].shape[1]), *(v.ravel().tolist() for v in p)) for c, shots in clips.items() for f, p in enumerate(shots)]
    return spark.createDataFrame(rows, "clip string, f int, height int, width int, r array<double>, g array<double>, b array<double>")


def test_motion_over_stretches(spark):
    rng = np.random.default_rng(1)
    shots = [[(rng.random((4, 5)) > 0.9) * 0.5 for _ in range(3)] for _ in range(M.STRETCH * 2 + 3)]
    got = {r.f: np.array(r.motion).reshape(4, 5) for r in M.with_motion(frames(spark, {"a": shots}), 0.1, 1).collect()}
    assert len(got) == len(shots)
    for f in range(len(shots)):
        hit = np.zeros((4, 5), bool)
        for g in (f - 1, f + 1):
            if 0 <= g < len(shots):
                hit |= np.mean([abs(p - q) for p, q in zip(shots[f], shots[g], strict=True)], 0) > 0.1
        assert (got[f] == M.grown(hit, 1)).all(), f


def test_clips_without_a_screen(spark):
    planes, _ = shot(24)
    grey = [np.full((24, 24), 0.5)] * 3
    rows = frames(spark, {"ok": [planes] * 3, "grey": [grey] * 3})
    profile = M.clip_profile(rows, band=3)
    assert {r.clip: (r.status, r.sampled_frames) for r in profile.collect()} == {"ok": ("ok", 3), "grey": ("fail", 0)}
    out = M.adaptive_matte(rows, profile.where("clip = 'ok'"), M.KeyRules(band=3)).collect()
    assert {(r.clip, r.status, r.alpha is None) for r in out} == {("ok", "ok", False), ("grey", "fail", True)}
    assert M.adaptive_matte(rows.limit(0), profile).count() == 0


def test_ladder(spark):
    tried = [
        ("ok", 0, None, 0.3, 0.5), ("ok", 1, 0.1, 0.3, 0.0), ("second", 0, None, 0.01, 0.0), ("second", 1, 0.1, 0.3, 0.2), ("second", 2, 0.14, 0.3, 0.01), ("second", 3, 0.18, 0.3, 0.0),
        ("review", 0, None, None, None), ("review", 1, 0.1, 0.3, 0.2), ("review", 2, 0.14, 0.2, 0.1), ("failed", 0, None, 0.0, 1.0), ("failed", 1, 0.1, 0.3, 0.9), ("failed", 2, 0.14, 0.03, 0.0), ("failed", 3, 0.18, 0.3, 0.0),
    ]
    out = L.outcome(spark.createDataFrame(tried, "clip string, attempt int, similarity double, visible double, residual double")).collect()
    assert {r.clip: (r.status, r.attempt, r.similarity) for r in out} == {"ok": ("ok", 0, None), "second": ("fallback", 2, 0.14), "review": ("review", 2, 0.14), "failed": ("failed", 2, 0.14)}


def test_loops(spark):
    def clip(name, n, period):
        return [(name, f, [float(f % period) / period, 0.5]) for f in range(n)]

    marks = spark.createDataFrame([*clip("direct", 40, 10), *clip("short", 12, 5), *clip("locked", 40, 7), *clip("still", 50, 9), *clip("plain", 50, 9), *clip("one", 1, 1), *clip("rough", 40, 400)], "clip string, f int, e array<double>")
    kinds = spark.createDataFrame([("direct", "optimised"), ("short", "optimised"), ("rough", "optimised"), ("locked", "locked"), ("still", "still")], "clip string, kind string")
    got = {r.clip: (r.mode, r.closure, r.closed, r.out_frames) for r in L.loops(marks, kinds, L.Loop(start_below=8, least=20, direct=0.001)).collect()}
    assert got == {
        "direct": ("best_span", "direct", 0, 31), "short": ("too_short", "crossfade", 2, 10), "locked": ("locked_endpoints", "locked", 0, 40), "still": ("plain", "none", 0, 38),
        "plain": ("plain", "crossfade", 7, 31), "one": ("plain", "none", 0, 1), "rough": got["rough"],
    }
    assert got["rough"][:2] == ("best_span", "crossfade")


def test_pipeline_row_for_each_clip(spark):
    planes, _ = shot(24)
    weak = painted([np.full((24, 24), c) for c in (0.30, 0.50, 0.31)], shot(24)[1] < 8, FUR)
    green = [np.full((24, 24), c) for c in KEY]
    rows = frames(spark, {"ok": [planes] * 8, "weak": [weak] * 8, "bare": [green] * 8})
    kinds = spark.createDataFrame([("ok", "locked")], "clip string, kind string")
    rules = M.KeyRules(band=3, margin=1, support=3)
    got = {r.clip: r for r in L.clip_pipeline(rows, kinds, rules, L.Ladder((0.05, 0.08)), band=3).collect()}
    assert {c: (r.status, r.attempt, r.frames, r.mode) for c, r in got.items()} == {"ok": ("ok", 0, 8, "locked_endpoints"), "weak": ("fallback", 1, 8, "plain"), "bare": ("failed", 1, 8, None)}
    assert got["ok"].key_colour == "0x0DE60F" and got["ok"].seam == pytest.approx(0)


def test_pipeline_reads_its_frames_once(spark):
    planes, _ = shot(24)
    rows = frames(spark, {"body": [planes] * 3, "grey": [[np.full((24, 24), 0.5)] * 3] * 2})
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    kinds = spark.createDataFrame([("body", "plain")], "clip string, kind string")
    out = L.clip_pipeline(rows.mapInArrow(counted, rows.schema), kinds, band=3)
    assert out.count() == 2 and read.value == 5
    marks = L.signatures(rows.withColumn("alpha", F.col("g")), 2)
    assert "Exchange" not in marks._jdf.queryExecution().toString()
    r, g, b = planes
    want = [v[y : y + 12, x : x + 12].mean() for y in (0, 12) for x in (0, 12) for v in (r * g, g * g, b * g, g)]
    assert marks.where("clip = 'body' and f = 0").first().e == pytest.approx(want)


def png(path, planes):
    """Writes r, g, b in 0..1 as an image file."""
    import struct
    import zlib

    v = (np.stack(planes, -1) * 255 + 0.5).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in v)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_from_image_files_to_metrics(spark, tmp_path):
    from framewell.functions import plugins
    from framewell.operators import providers as V
    from framewell.sources import io

    planes, d = shot(32)
    for f in range(3):
        png(tmp_path / "clip=body" / f"f_{f}.png", planes)
        png(tmp_path / "clip=grey" / f"f_{f}.png", [np.full((32, 32), 0.5)] * 3)
    plugins.register_provider("small_key", V.adaptive_key(M.KeyRules(band=3)))
    metrics, errors = V.evaluated(io.frames(spark, str(tmp_path)), "small_key", 32, 32)
    got = metrics.collect()
    assert sorted((r.clip, r.name) for r in got) == [("body", f"f_{f}.png") for f in range(3)]
    body = d < 32 / 3
    assert all(r.background_alpha_mean < 0.01 and r.foreground_loss_mean < 0.01 and r.fragment_count == 0 for r in got)
    assert all(r.coverage_pct == pytest.approx(body.mean() * 100, abs=1) and r.mean_alpha == pytest.approx(body.mean(), abs=0.01) for r in got)
    assert {(r.clip, r.error) for r in errors.collect()} == {("grey", "no reliable green screen")}
    with_profile = M.clip_profile(frames(spark, {"body": [planes] * 3}), band=3).first()
    assert V.profile_of([planes] * 3, band=3) == (pytest.approx(with_profile.bg_floor), pytest.approx([with_profile.key_r, with_profile.key_g, with_profile.key_b]))


def test_names_of_long_clips(spark, tmp_path, monkeypatch):
    """Frames from 10000 on come after those before them, since providers go by names."""
    from framewell.operators import providers as V
    from framewell.plans import bindings

    n = 10_003
    spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.0).cast("float")] * 64).alias("embedding"), F.lit(0).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    taken = []
    monkeypatch.setattr(V, "evaluated", lambda shots, *_: taken.append(shots) or (shots.select("clip", "name", *[F.lit(0.0).alias(c) for c in (*A1, "mean_alpha")]), None))
    out = bindings.queries()["u1_provider_metrics"](spark, str(tmp_path))
    names = [r.name for r in taken[0].select("name").collect()]
    assert len(names) == n and max(names).endswith("10002") and sorted(names)[9999].endswith("9999")
    assert {"f_0000", "f_9999", "f_10002"} <= {r.name for r in out.select("name").collect()}
