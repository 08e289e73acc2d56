"""Variants A and B, the cube of providers and actions, frontiers of named sets, states of result files."""

import json
import time
import random

import pytest
from pyspark.sql import functions as F

from framewell.operators import comparison as C
from framewell.operators import contracts as K


def test_changes_and_per_second(spark):
    rows = [(1, "a", 0.10, 2.0, 5, 1.0), (1, "b", 0.05, 4.0, 5, 3.0), (2, "a", 0.0, 2.0, 1, 1.0), (2, "b", 1.0, 0.0, 1, 1.0), (3, "b", 1.0, 2.0, 3, 1.0), (4, "x", 1.0, 1.0, 2, 1.0), (None, "a", 1.0, 1.0, 2, 2.0), (None, "a", 3.0, 1.0, 2, 2.0), (None, "b", 3.0, 1.0, 2, None)]
    df = spark.createDataFrame(rows, "id int, v string, error double, seconds double, frames int, score double").withColumn("rate", C.per_second(F.col("error"), F.col("seconds"), F.col("frames")))
    got = {r.id: r for r in C.changes(df, ["id"], "v", "a", "b", {"error": True, "rate": True, "score": False}).collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].base_rate == pytest.approx(0.1 / (2.0 / 4)) and got[1].current_rate == pytest.approx(0.05)
    assert got[1].change_error == pytest.approx(50) and got[1].change_rate == pytest.approx(75) and got[1].change_score == pytest.approx(200)
    assert got[2].change_error is None and got[2].base_rate == 0 and got[2].current_rate is None  # no base, one frame, no time
    assert got[3].base_error is None and got[3].change_error is None
    assert got[None].base_error == 2 and got[None].change_error == pytest.approx(-50) and got[None].change_score is None


def test_cube(spark):
    configs = spark.createDataFrame(
        [("base", "c1", True, True), ("base", "c2", True, True), ("p", "c1", True, None), ("lost", "c1", True, True), ("foreign", "c1", True, True), ("quiet", "c1", True, True)],
        "provider string, config string, eligible_for_final boolean, passes_all_guardrails boolean",
    )
    recommended = spark.createDataFrame([("base", "c2"), ("p", "c1"), ("lost", "c9"), ("foreign", "c1"), ("quiet", None)], "provider string, config string")
    known = spark.createDataFrame([(p, i) for i, p in enumerate(["base", "base_v2", "base_v3", "p", "lost", "quiet"])], "provider string, place int")
    runs = [("walk", "base", "e1", 10, {"s": 1}), ("walk", "base_v2", "e2", 10, {"s": 2}), ("walk", "base_v3", "e3", 10, {"s": 3}), ("walk", "p", "e4", 10, {"s": 4}), ("sleep", "base", "e1", 20, {"s": 5}), ("sleep", "base_v2", "e2", 20, {"s": "x"}), ("sleep", "foreign", "e9", 20, {"s": 6})]
    manifest = spark.createDataFrame([(*r[:4], json.dumps(r[4])) for r in runs], "action string, provider string, evaluation_key string, frame_count int, t string").withColumn("v", F.call_function("parse_json", "t")).drop("t")
    evaluation = spark.createDataFrame([("walk", "e1", 0.1), ("walk", "e2", 0.2), ("walk", "e3", 0.3), ("walk", "e4", 0.4), ("sleep", "e1", 0.5)], "action string, evaluation_key string, mae double")
    shapes = K.runtime_shapes(spark, [(p, "frame_ms", "$.s", 1000.0, True, None) for p in ("base", "base_v2", "base_v3", "p")])
    got = {(r.provider, r.action): r for r in C.comparison_cube(configs, recommended, known, manifest, evaluation, shapes, "base", ["base_v2", "base_v3"]).collect()}
    assert set(got) == {(p, a) for p in ("base", "base_v2", "base_v3", "p") for a in ("walk", "sleep")}
    assert [got[p, "walk"].frame_ms for p in ("base", "base_v2", "base_v3", "p")] == [100, 200, 300, 400]
    assert [got[p, "walk"].mae for p in ("base", "base_v2", "base_v3", "p")] == [0.1, 0.2, 0.3, 0.4]
    assert {p: got[p, "sleep"].state for p in ("base", "base_v2", "base_v3", "p")} == {"base": "ok", "base_v2": "no evaluation", "base_v3": "no manifest entry", "p": "no manifest entry"}
    assert got["base_v2", "sleep"].frame_ms is None and got["base_v2", "walk"].config == "c2"
    assert got["base_v3", "walk"].eligible and not got["p", "walk"].eligible  # an unknown guardrail is none passed


def test_frontiers_of_sets(spark):
    rng = random.Random(5)
    rows = [(f"k{i}", rng.randint(0, 9), rng.choice([None, *range(10)]), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, x int, y int, side int").repartition(7)
    sets = {"all": F.lit(True), "odd": F.col("side") == 1, "none": F.col("x") > 99}
    got = {(r.frontier, r.key) for r in C.frontiers(df, "key", ["x", "y"], sets).collect()}

    def front(of):
        of = [r for r in of if r[2] is not None]
        return {r[0] for r in of if not any(o[1] <= r[1] and o[2] <= r[2] and o[1:3] != r[1:3] for o in of)}

    assert got == {("all", k) for k in front(rows)} | {("odd", k) for k in front([r for r in rows if r[3]])}
    assert C.frontiers(df.limit(0), "key", ["x", "y"], sets).count() == 0


def test_states_of_files(spark):
    config = {"status": "ok", "output_dir": "o", "quality": dict.fromkeys(K.QUALITY, 0.1), "runtime": {}}
    good = {"provider": "p", "official_docs": [{"url": "https://d"}], "configs": [{"id": x, **config} for x in "abc"], "recommendation": {"config_id": "b"}}
    files = {"good": good, "few": good | {"configs": good["configs"][1:]}, "object": good | {"configs": {}}, "broken": None}
    docs = spark.createDataFrame([(p, json.dumps(v) if v else "{") for p, v in files.items()], "path string, t string").select("path", F.call_function("try_parse_json", "t").alias("v"))
    got = {r.path: r for r in C.file_states(docs).collect()}
    assert (got["good"].n_configs, got["good"].n_errors, got["good"].first_error, got["good"].status) == (3, 0, None, 0)
    assert (got["few"].n_configs, got["few"].status) == (2, 2) and got["few"].first_error.startswith("expected at least 3")
    assert (got["object"].n_configs, got["object"].status) == (0, 2)
    assert (got["broken"].n_configs, got["broken"].first_error, got["broken"].status) == (0, "not a JSON document", 2)


def test_state_of_a_file_with_many_configurations(spark):
    file = {"provider": "p", "official_docs": [{"url": "https://d"}], "configs": [{"id": f"c{i % 2998}"} for i in range(3000)], "recommendation": {"config_id": "c5"}}
    docs = spark.createDataFrame([("many", json.dumps(file))], "path string, t string").select("path", F.call_function("try_parse_json", "t").alias("v"))
    began = time.time()
    assert [tuple(r) for r in C.file_states(docs).collect()] == [("many", 3000, 2, "duplicate config id: c0", 2)]
    assert time.time() - began < 25
