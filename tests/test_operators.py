"""Algebraic checks and the small synthetic scenes."""

import pytest
from pyspark.sql import functions as F

from framewell.functions import exprs as X
from framewell.operators import clip as C
from framewell.operators import pixels as P
from framewell.operators import telemetry as T
from framewell.operators import tuning as U


def plane(spark, frames, value="v"):
    rows = [("c", f, y, x, float(v)) for f, grid in enumerate(frames) for y, row in enumerate(grid) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, f"clip string, f int, y int, x int, {value} double")


def test_contrast_keeps_fixed_points(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,)], "p double")
    got = [r[0] for r in df.select(X.odds_contrast(F.col("p"), 1.4)).collect()]
    assert (got[0], got[2], got[4]) == (0.0, pytest.approx(0.5), 1.0) and got[1] < 0.25 and got[3] > 0.75


def test_components(spark):
    grid = ["11000", "00100", "00000", "11011", "10001"]
    parts = P.components(plane(spark, [[list(map(int, r)) for r in grid]]).where("v = 1"), 5)
    got = sorted((r.label, r.area, r.x0, r.y0, r.x1, r.y1) for r in parts.collect())
    assert got == [(0, 3, 0, 0, 3, 2), (15, 3, 0, 3, 2, 5), (18, 3, 3, 3, 5, 5)]
    assert P.largest(parts).first().label == 0
    spiral = ["11111", "00001", "11101", "10001", "11111"]
    one = P.components(plane(spark, [[list(map(int, r)) for r in spiral]]).where("v = 1"), 5).collect()
    assert [(r.label, r.area) for r in one] == [(0, 17)]


def test_morphology(spark):
    px = plane(spark, [[[0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]]])
    grown = {(r.y, r.x) for r in P.morphology(px, "v", "max", 1).where("v = 1").collect()}
    assert grown == {(y, x) for y in range(3) for x in range(3)}
    assert P.morphology(P.morphology(px, "v", "max", 1), "v", "min", 1).where("v = 1").count() >= 1


def test_fragment_voting(spark):
    body = [[1 if 1 <= x <= 4 and 1 <= y <= 4 else 0 for x in range(12)] for y in range(12)]
    speck = [row[:] for row in body]
    speck[10][10] = 1
    px = plane(spark, [body, speck, body])
    out = C.unsupported_fragments(px.where("v = 1"), px, 12).collect()
    assert [(r.f, r.detached, r.removed, r.pixels_removed, r.protected) for r in out] == [(1, 1, 1, 1, 0)]


def test_repair_never_lowers(spark):
    px = plane(spark, [[[0.9, 0.1, 0.9], [0.9, 0.1, 0.9], [0.9, 0.9, 0.9]]])
    mask = px.select("clip", "f", "y", "x", F.lit(1).alias("m"))
    got = C.repaired(px, mask, "v", 0.6, 0.3, 0).collect()
    assert all(r.v >= r.was for r in got) and sum(r.severe for r in got) == 2


def test_seam_and_span(spark):
    same = [("a", f, [float(f % 4)] * 3) for f in range(41)]
    frames = spark.createDataFrame([*same, ("b", 0, [1.0] * 3)], "clip string, f int, e array<double>")
    seams = {r.clip: r.closure for r in C.seam(frames).collect()}
    assert seams == {"a": "direct", "b": "direct"}
    spans = {r.clip: r for r in C.best_span(frames, 8, 20).collect()}
    assert spans["b"].mode == "too_short" and (spans["a"].start, spans["a"].end) == (0, 40)


def test_frontier(spark):
    rows = [(str(i), float(i % 7), float((i * 5) % 11), None if i == 3 else 1.0) for i in range(60)] + [("dup", 0.0, 0.0, 1.0), ("dup2", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, a double, b double, c double").repartition(5)
    got = {r.key for r in U.frontier(df, "key", ["a", "b", "c"]).collect()}
    full = [r for r in rows if None not in r]
    want = {r[0] for r in full if not any(all(p <= q for p, q in zip(s[1:], r[1:], strict=True)) and s[1:] != r[1:] for s in full)}
    assert got == want and {"dup", "dup2"} <= got


def test_scores_stay_in_range(spark):
    df = spark.createDataFrame([("g", str(i), float(i % 5), float(-i)) for i in range(20)], "g string, key string, a double, b double")
    got = [r.score for r in U.group_scores(df, "g", "key", {"a": 2.0, "b": 1.0}).collect()]
    assert min(got) >= 0 and max(got) <= 3
    assert U.selection_scores(df, "key", {"a": 1.0}).count() == 20


def test_upsert_is_idempotent(spark):
    schema = "pet string, clip string, file string, ord int, seconds double"
    old = spark.createDataFrame([("p", "idle", None, 0, 1.0), ("p", None, "a.png", 1, 2.0), ("p", None, None, 2, 3.0)], schema)
    new = spark.createDataFrame([("p", "idle", None, 5, 9.0), ("q", "idle", None, 6, 8.0)], schema)
    once = T.upsert(old, new, "pet")
    assert sorted(r.seconds for r in once.collect()) == [2.0, 3.0, 8.0, 9.0]
    assert sorted(map(str, T.upsert(once, new, "pet").collect())) == sorted(map(str, once.collect()))


def test_baseline_zero_and_null(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 2.0, None)], "key string, m double, n double")
    got = {r.key: r for r in U.against_baseline(df, df.where("key = 'a'"), ["m", "n"], [("m", "m", 1.0, 0.0), ("n", "n", 1.0, 0.0)]).collect()}
    assert got["b"].ratio_m is None and not got["b"].guardrail and got["a"].guardrail


def rgba(spark, rows):
    return spark.createDataFrame([("c", 0, y, x, *map(float, p)) for y, row in enumerate(rows) for x, p in enumerate(row)], "clip string, f int, y int, x int, r double, g double, b double, a double")


GREEN, RED, GREY = (0.1, 0.9, 0.1), (0.9, 0.1, 0.1), (0.5, 0.5, 0.5)


def test_confident_background_is_reached_from_the_border(spark):
    grid = [[(*GREEN, 0)] * 5, [(*GREEN, 0), *[(*RED, 1)] * 3, (*GREEN, 0)], [(*GREEN, 0), (*RED, 1), (*GREEN, 1), (*RED, 1), (*GREEN, 0)], [(*GREEN, 0), *[(*RED, 1)] * 3, (*GREEN, 0)], [(*GREEN, 0)] * 5]
    px = P.confident(rgba(spark, grid), 5, 5)
    assert {(r.y, r.x) for r in px.where("bg").collect()} == {(y, x) for y in range(5) for x in range(5) if y in (0, 4) or x in (0, 4)}
    assert px.where("fg").count() == 8 and not px.where("y = 2 and x = 2").first().reached


def test_frame_metrics_by_hand(spark):
    # background: alpha 0, 0.2 (mean 0.1); foreground: alpha 1, 0.7 (loss 0.15); the grey pixel is foreground too: its score is 0
    grid = [[(*GREEN, 0.0), (*GREEN, 0.2)], [(*RED, 1.0), (*GREY, 0.7)]]
    px = P.confident(rgba(spark, grid), 2, 2).withColumns({f"out_{c}": F.col(c) for c in "rgb"})
    got = P.frame_metrics(px, 2).first()
    assert got.background_alpha_mean == pytest.approx(0.1) and got.foreground_loss_mean == pytest.approx(0.15) and got.pseudo_mae == pytest.approx(0.125)
    assert got.green_fringe == pytest.approx((0.8 * 0.2 + 0.0) / 2)  # soft: alpha 0.2 with green over red and blue by 0.8, and 0.7 with none
    assert got.opaque_green_leak_pct == 0 and got.soft_alpha_pct == 50 and got.coverage_pct == 75
    assert got.fragment_pct == 0 and got.fragment_count == -1  # one component of three pixels, none of four
    nothing = P.frame_metrics(P.confident(rgba(spark, [[(*GREY, 0.0)]]), 1, 1).withColumns({f"out_{c}": F.col(c) for c in "rgb"}), 1).first()
    assert nothing.background_alpha_mean == 1 and nothing.foreground_loss_mean == 1 and nothing.fragment_count == 0


def test_fragments_by_hand(spark):
    grid = ["1111.1", "......", "11..11", "11..11"]
    px = rgba(spark, [[(*GREY, 1.0 if c == "1" else 0.0) for c in row] for row in grid])
    got = P.fragments(px, F.col("a") > 0.08, 6).first()
    assert got.fragment_pct == pytest.approx(9 / 13 * 100) and got.fragment_count == 2  # areas 4, 1, 4, 4


def test_matte_qa_by_hand(spark):
    rows = []
    for f in range(7):  # step 1, six samples, the middle one is frame 3
        for i in range(8):
            seen = f != 5 and i < (2 if f == 3 else 4)
            rows.append(("c", f, 0, i, 0.2, 0.9 if f == 2 and i == 0 else 0.2, 0.2, 1.0 if seen else 0.0))
    px = spark.createDataFrame(rows, "clip string, f int, y int, x int, r double, g double, b double, a double")
    got = P.matte_qa(px).first()
    assert got.residual == 1.0 and got.mid_visible == 0.25 and got.sampled == 6  # frame 5 is empty
    got = P.matte_qa(px.where("f <> 5")).first()
    assert got.residual == 0.0  # pixel 0 is more than two pixels from the outside in frame 2: only what is in the frame counts


def test_plane_comparison_by_hand(spark):
    want = plane(spark, [[[1.0, 1.0, 1.0, 0.0]]])
    got = P.plane_comparison(plane(spark, [[[1.0, 0.9, 0.4, 0.1]]]), want, "v").first()
    assert got.reference_interior_soft_fraction == pytest.approx(2 / 3) and got.reference_interior_hole_fraction == pytest.approx(1 / 3) and got.reference_background_leak_fraction == 1
    assert got.alpha_mae == pytest.approx((0 + 25 + 153 + 26) / 255 / 4)


def test_edge_luminance_by_hand(spark):
    white, dark = (1.0, 1.0, 1.0), (0.2, 0.2, 0.2)
    px = rgba(spark, [[(*white, 0.0), (*white, 1.0), (*dark, 1.0), (*dark, 1.0)]])
    got = P.edge_luminance(px, 1.0, (2.0, 3.0), 3).first()
    assert (got.edge_luma_mean, got.inner_luma_mean, got.bright_neutral_edge_pct) == (pytest.approx(1.0), pytest.approx(0.2), 100)
    thin = P.edge_luminance(px.where("x < 2"), 1.0, (2.0, 3.0), 3).first()
    assert thin.inner_luma_mean == thin.edge_luma_mean and thin.edge_luma_excess == 0


def test_spans_near_the_least_length(spark):
    def of(n):
        return [(f"n{n}", f, [float(f)]) for f in range(n)]

    frames = spark.createDataFrame(of(21) + of(22) + of(40), "clip string, f int, e array<double>")
    spans = {r.clip: r for r in C.best_span(frames, 8, 20).collect()}
    assert spans["n21"].mode == "too_short" and spans["n21"].start is None
    assert spans["n22"].mode == "best_span" and spans["n22"].start <= 1


def test_crossfade_closes_the_clip(spark):
    frames = spark.createDataFrame([("c", f, [float(f)]) for f in range(10)] + [("d", f, [float(f)]) for f in range(4)], "clip string, f int, e array<double>")
    got = {(r.clip, r.f): r.e[0] for r in C.crossfade(frames).collect()}
    assert len(got) == 14 and [got["c", f] for f in range(8)] == list(map(float, range(8)))
    assert got["c", 8] == pytest.approx(8 * 2 / 3) and got["c", 9] == pytest.approx(9 / 3 + 2 / 3)
    assert [got["d", f] for f in range(4)] == [0, 1, 2, 3]


def test_guardrails_and_fallback_baseline(spark):
    cfg = spark.createDataFrame([("a", 1.0, 0.001), ("b", 1.5, 0.004), ("c", 1.6, 0.0041), ("d", None, 0.0)], "key string, loss double, back double")
    limits = [("fg", "loss", 1.5, 0.0), ("bg", "back", 4.0, 0.004)]
    got = {r.key: (r.guard_fg, r.guard_bg, r.guardrail) for r in U.against_baseline(cfg, cfg.where("key = 'a'"), ["loss", "back"], limits).collect()}
    assert got == {"a": (True, True, True), "b": (True, True, True), "c": (False, False, False), "d": (False, True, False)}
    assert U.baseline_of(cfg, F.col("key") == "b", ["loss", "back"], cfg.where("key = 'a'")).first().source == "b"
    assert U.baseline_of(cfg, F.col("key") == "d", ["loss", "back"], cfg.where("key = 'a'")).first().source == "legacy"


def test_out_of_bounds_reports_every_parameter(spark):
    rows = spark.createDataFrame([(1, {"a": 5.0, "b": 9.0}), (2, {"a": 0.0, "b": 1.0})], "id int, values map<string,double>")
    bounds = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], "parameter string, lo double, hi double")
    assert sorted((r.id, r.parameter) for r in U.out_of_bounds(rows, ["id"], "values", bounds).collect()) == [(1, "a"), (1, "b")]


def test_places_over_ranges(spark):
    from framewell.operators.ranks import placed

    rows = [((i * 37) % 101 % 20, i) for i in range(500)]
    got = {(r.v, r.i): r.place for r in placed(spark.createDataFrame(rows, "v int, i int").repartition(7), ["v", "i"], "place").collect()}
    assert [got[r] for r in sorted(rows)] == list(range(500))


def test_places_of_ties_and_nulls(spark):
    from framewell.operators.ranks import placed

    rows = [(None if i % 3 else 7, i, "x") for i in range(400)] + [(9, 1, "x")] * 3
    df = spark.createDataFrame(rows, "v int, i int, _at string").repartition(5)
    got = placed(df, [F.desc("v"), "i"], "place").collect()
    assert sorted(r.place for r in got) == list(range(403)) and all(r["_at"] == "x" for r in got)
    # descending, nulls last
    assert [(r.v, r.i) for r in sorted(got, key=lambda r: r.place)] == sorted(((v, i) for v, i, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert placed(df.limit(0), ["v"], "place").count() == 0


def test_selection_scores_of_repeated_keys(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.0, 4.0), ("b", 2.0, 4.0), ("c", 9.0, 0.5)]
    got = sorted((r.key, round(r.score, 9)) for r in U.selection_scores(spark.createDataFrame(rows, "key string, a double, b double"), "key", {"a": 3.0, "b": 1.0}).collect())
    assert got == [("a", 1.0), ("a", round(3 / 3 + 1 / 3, 9)), ("b", round(3 * 2 / 3 + 2 / 3, 9)), ("c", 3.0)]


def test_nearest_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    cells = [("c", f, y, x, rng.random(), rng.choice(["w", "s", "n"])) for f in range(3) for y in range(9) for x in range(7)]
    px = spark.createDataFrame(cells, "clip string, f int, y int, x int, v double, kind string")
    got = {(r.f, r.y, r.x): (r.v, r.distance) for r in P.nearest(px, F.col("kind") == "w", F.col("kind") == "s", "v", 2).collect()}
    for _, f, y, x, _, kind in cells:
        if kind == "w":
            near = sorted(((b - y) ** 2 + (a - x) ** 2, b, a, v) for _, g, b, a, v, k in cells if g == f and k == "s" and abs(b - y) <= 2 and abs(a - x) <= 2)
            want = (near[0][3], near[0][0] ** 0.5) if near else (None, None)
            assert got[f, y, x] == pytest.approx(want) if near else got[f, y, x] == want


def test_smoothing_sweeps_forward_and_back(spark):
    rows = [("a", f, 0, 0, v, 0.5) for f, v in enumerate([0.4, 0.8, 0.6])] + [("b", f, 0, 0, v, 0.5) for f, v in enumerate([0.4, 0.8])]
    px = spark.createDataFrame(rows, "clip string, f int, y int, x int, a double, s double")

    def series(clip, **how):
        return [r.a for r in C.smoothed(px, "a", ["s"], **how).where(f"clip = '{clip}'").orderBy("f").collect()]

    # forward: 0.4, 0.8 - 0.65 * 0.4 = 0.54, 0.6 - 0.65 * 0.06 = 0.561; back: 0.54 + 0.65 * 0.021, 0.4 + 0.65 * 0.15365
    assert series("a", both=False) == pytest.approx([0.4, 0.54, 0.561])
    assert series("a") == pytest.approx([0.4998725, 0.55365, 0.561])
    assert series("b") == [0.4, 0.8]  # two frames stay as they are
    # the box of alphas over 0.55 is one pixel tall: its lower part starts at 0 + rint(0.52) = 1, below it
    assert series("a", lower=True) == pytest.approx([0.4998725, 0.55365, 0.561])


def test_quoted_like_a_path(spark):
    row = spark.createDataFrame([("a b/c*~+é?.-_",), (None,)], "s string").select(X.quoted(F.col("s")).alias("q")).collect()
    assert [r.q for r in row] == ["a%20b/c%2A~%2B%C3%A9%3F.-_", None]


def test_compact_parameters(spark):
    rows = spark.createDataFrame([({"a": "1", "b": None},), ({},), (None,)], "m map<string, string>")
    assert sorted(r.c for r in rows.select(X.compact(F.col("m")).alias("c")).collect()) == ["a=1, b=None", "default", "default"]


def test_fragments_are_voted_on(spark):
    """A part that the neighbours have stays, one that they don't goes, and a large one stays whatever they show."""
    import numpy as np

    shots = []
    for f in range(5):
        v = np.zeros((64, 64))
        v[20:44, 24:44] = 1.0
        v[44:46, 24:44] = 0.3  # soft, of the body
        v[28:34, 12:18] = 1.0
        shots.append(v)
    shots[2][4:7, 52:55] = 1.0
    shots[2][10:12, 52:53] = 0.3  # two soft pixels
    shots[2][46:58, 2:14] = 1.0
    px = plane(spark, shots)
    out, counts = C.voted_fragments(px, "v", 64, 64 * 64)
    assert {r.f: tuple(r)[2:] for r in counts.collect()} == {f: (4, 2, 11, 1) if f == 2 else (1, 0, 0, 0) for f in range(5)}
    got = np.zeros((5, 64, 64))
    for r in out.collect():
        got[r.f, r.y, r.x] = r.v
    want = np.array(shots)
    want[2][4:12, 52:55] = 0
    assert (got == want).all()
    lone, none = C.voted_fragments(px.where("f = 2"), "v", 64, 64 * 64)
    assert none.count() == 0 and lone.where("v > 0").count() == px.where("f = 2 and v > 0").count()
