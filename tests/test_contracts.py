"""Rules as rows, the contract of result files, and runtimes of differing shapes."""

import json
import time

import pytest
from pyspark.sql import functions as F

from framewell.operators import contracts as K
from framewell.operators import rules as R


def parsed(spark, docs):
    rows = [(p, d if isinstance(d, str) else json.dumps(d)) for p, d in docs.items()]
    return spark.createDataFrame(rows, "path string, text string").select("path", F.call_function("try_parse_json", "text").alias("v"))


def good(**change):
    config = {"status": "ok", "output_dir": "out/a", "quality": dict.fromkeys(K.QUALITY, 0.1), "runtime": {"mean_inference_ms": 3, "peak_vram_mb": None}, "temporal_alpha_mae": 1e-3}
    out = {"provider": "p", "official_docs": [{"url": "https://d"}], "configs": [{"id": x, **config} for x in "abc"], "recommendation": {"config_id": "b"}}
    return out | change


def test_every_message(spark):
    configs = good()["configs"]
    bad = json.loads(json.dumps(configs))
    bad[0]["quality"]["green_fringe"] = "0.1"
    bad[0]["quality"]["pseudo_mae"] = True
    bad[0]["runtime"]["end_to_end_ms"] = [1]
    bad[1]["temporal_alpha_mae"] = {}
    bad[2]["output_dir"] = "out/lost"
    infinite = json.dumps(good()).replace("0.001", "1e999", 1)
    docs = {
        "good": good(), "named": good(provider={"name": "p"}), "blank": good(provider="  "), "number": good(provider=7), "none": good(provider=None), "nameless": good(provider={"name": ""}),
        "no docs": good(official_docs=[]), "docs object": good(official_docs={}), "bad docs": good(official_docs=[{"url": "https://d"}, {"url": "ftp://d"}, "https://d", {}]),
        "no configs": good(configs=[], recommendation={}), "configs text": good(configs="x", recommendation={}), "two": good(configs=configs[:2]), "items": good(configs=["x", 1, None, {"id": ""}, {"id": 5}, *configs]),
        "twice": good(configs=[*configs, configs[0], configs[0]]), "numbers": good(configs=bad), "infinite": infinite, "unknown": good(recommendation={"primary": "z"}), "later key": good(recommendation={"config_id": "", "id": "c"}), "broken": "{", "no recommendation": good(recommendation=None),
    }
    existing = spark.createDataFrame([("out/a",), ("out/a",)], "output_dir string")
    got = {}
    for r in K.contract_errors(parsed(spark, docs), existing).collect():
        got.setdefault(r.path, []).append(r.error)
    want = {
        **dict.fromkeys(("blank", "number", "none", "nameless"), ["provider must be a non-empty string"]), **dict.fromkeys(("no docs", "docs object"), ["official_docs must contain at least one item"]),
        "bad docs": [f"official_docs[{i}] must contain an HTTP(S) url" for i in (1, 2, 3)], **dict.fromkeys(("no configs", "configs text"), ["configs must contain at least one configuration", "expected at least 3 configurations, got 0"]),
        "two": ["expected at least 3 configurations, got 2"], "items": [f"configs[{i}] must be an object" for i in range(3)] + [f"configs[{i}].id must be a non-empty string" for i in (3, 4)], "twice": ["duplicate config id: a"] * 2,
        "numbers": ["configs[0].quality.pseudo_mae must be finite number or null", "configs[0].quality.green_fringe must be finite number or null", "configs[0].runtime.end_to_end_ms must be finite number or null", "configs[1].temporal_alpha_mae must be finite number or null", "configs[2].output_dir does not exist: out/lost"],
        "infinite": ["configs[0].temporal_alpha_mae must be finite number or null"], "unknown": ["recommendation references unknown config: z"], "broken": ["not a JSON document"],
    }
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    lax = K.contract_errors(parsed(spark, docs)).where("path = 'numbers'")
    assert lax.count() == 4 and K.contract_errors(parsed(spark, docs).limit(0), existing).count() == 0


def test_a_file_of_many_configurations(spark):
    """Its work grows with the configurations; two rows of one path are two files."""
    many = good(configs=[{"id": f"c{i % 3000}", "quality": {"pseudo_mae": "bad" if i == 7 else None}} for i in range(3002)], recommendation={"id": "c2999"})
    rows = spark.createDataFrame([("many", json.dumps(many)), ("twin", json.dumps(good())), ("twin", json.dumps(good()))], "path string, text string")
    began = time.time()
    got = sorted(tuple(r) for r in K.contract_errors(rows.select("path", F.call_function("try_parse_json", "text").alias("v"))).collect())
    assert got == [("many", "configs[7].quality.pseudo_mae must be finite number or null"), ("many", "duplicate config id: c0"), ("many", "duplicate config id: c1")]
    assert time.time() - began < 25


def test_rules(spark):
    rows = [("SAM2 small", "a"), ("x", "Postprocess_Binary"), ("official_matanyone_v1", "a"), ("rembg", "alpha_fur_safe_1"), ("rembg", "a"), ("adaptive_green_baseline", "halo_cartoon"), ("adaptive_green_baseline", "halo_mid"), (None, None), ("sam2", "postprocess_binary")]
    table = spark.createDataFrame([(i, *r, float(i)) for i, r in enumerate(rows)], "n int, provider string, id string, mae double")
    rules = R.rule_table(spark, R.ELIGIBILITY)
    got = {r.n: r for r in R.flagged(table, rules, ["provider", "id"]).collect()}
    assert [got[i].eligible_for_final for i in range(9)] == [False, False, False, False, True, False, True, True, False]
    assert [got[i].fractional_alpha for i in range(9)] == [False, False, True, True, True, True, True, True, False] and not got[2].commercial_use and not got[5].visual_review and got[5].domain_fit
    assert got[8].exclusion_reasons == ["a binary mask is no fur matte", "binary post-processing removes soft fur"] and got[4].exclusion_reasons == []
    more = R.rule_table(spark, [*R.ELIGIBILITY, (20, "domain_fit", "high", "mae", "at_least", "6"), (21, "domain_fit", "nameless", "id", "missing", None)])
    again = {r.n: r.exclusion_reasons for r in R.flagged(table, more, ["provider", "id", "mae"]).collect()}
    assert again[6] == ["high"] and again[7] == ["high", "nameless"] and again[4] == []
    assert all(r.eligible_for_final for r in R.flagged(table, rules.limit(0), ["provider"]).collect())
    with pytest.raises(Exception, match="no test like"):
        R.flagged(table, R.rule_table(spark, [(1, "f", "r", "id", "like", "a")]), ["id"], ["f"]).collect()


def test_limits(spark):
    rows = spark.createDataFrame([("a", {"m": 1.5, "n": 0.003}), ("b", {"m": 1.6}), ("c", {"n": None})], "key string, metrics map<string, double>")
    limits = spark.createDataFrame([("first", "m", 1.0, 1.5, 0.0), ("second", "n", 0.0, 4.0, 0.004)], "name string, metric string, base double, factor double, least double")
    got = {(r.key, r.name): r.holds for r in R.limited(rows, limits, ["key"]).collect()}
    assert got == {("a", "first"): True, ("a", "second"): True, ("b", "first"): False, ("b", "second"): False, ("c", "first"): False, ("c", "second"): False}


def test_runtimes(spark):
    runs = parsed(spark, {"ben2": {"summary": {"model_load_ms": 1000, "warmup_total_ms": 500, "measured_wall_ms": 2000.0, "inference_mean_excluding_first_ms": 7, "mean_total_ms": 9, "max_cuda_pipeline_peak_allocated_mib": 11}}, "rembg": {"run_wall_seconds": 5, "batch_wall_seconds": "4"}})
    runs = runs.select(F.col("path").alias("provider"), F.lit(4).alias("frame_count"), "v")
    shapes = K.runtime_shapes(spark)
    got = {r.provider: tuple(r)[3:] for r in K.harmonised(runs, shapes).collect()}
    assert got["ben2"] == (3.5, 2.0, 7.0, 9.0, 11.0)
    assert got["rembg"] == (5.0, 4.0, None, None, None)
    own = K.runtime_shapes(spark, [*K.RUNTIME_SHAPES, *K._shape("mine", frame_ms=("a.b", 1000, "/frame"), vram_mb=0.0)])
    mine = parsed(spark, {"mine": {"a": {"b": 2}}}).select(F.col("path").alias("provider"), F.lit(4).alias("frame_count"), "v")
    assert tuple(K.harmonised(mine, own).first())[3:] == (None, None, None, 500.0, 0.0)
    with pytest.raises(Exception, match="no runtime shape for mine"):
        K.harmonised(mine, shapes).collect()
