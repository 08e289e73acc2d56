"""Readers on files written by hand, broken ones among them."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from framewell.functions import plugins
from framewell.operators import telemetry as T
from framewell.sources import io


def put(path, value, bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(("﻿" if bom else "") + (value if isinstance(value, str) else json.dumps(value)), encoding="utf-8")


def test_step_events(spark, tmp_path):
    put(tmp_path / "a/metrics.json", {
        "stylize": [{"file": "s.png", "model": "m", "seconds": 3, "usage": {"total_tokens": 10}}],
        "matte": [{"clip": "idle", "seconds": 2.5, "loop_meta": None}, {"clip": "idle", "seconds": 4}, {"clip": "run", "source_clip": "fast_walk", "seconds": 0}, {"seconds": 1}, {"source_clip": "sleep"}],
    })
    put(tmp_path / "b/metrics.json", '{"stylize": [')
    put(tmp_path / "c/metrics.json", {"animate": "not a list"})
    rows = io.step_events(spark, str(tmp_path / "*/metrics.json"))
    got = {(r.pet_id, r.step, r.key, r.seconds, r.error) for r in rows.collect()}
    assert ("a", "stylize", "file:s.png", 3.0, None) in got and ("a", "matte", "clip:idle", 2.5, None) in got and ("a", "matte", "ord:3", 1.0, None) in got
    assert ("b", None, None, None, "unreadable") in got and not [g for g in got if g[0] == "c"]
    rows = rows.where("error is null").withColumn("source_clip", F.try_variant_get("detail", "$.source_clip", "string"))
    active = T.active_only(rows, ["idle", "sleep", "fast_walk"]).collect()
    assert sorted((r.step, r.ord) for r in active) == [("matte", 0), ("matte", 1), ("matte", 3), ("matte", 4), ("stylize", 0)]
    kept = T.latest(rows.where("step = 'matte'"), ["pet_id", "key"], ["ord"]).where("key = 'clip:idle'").collect()
    assert [r.seconds for r in kept] == [4.0]


def test_tasks_and_manifests(spark, tmp_path):
    put(tmp_path / "t/task_idle.json", {"id": "1", "status": "succeeded", "content": {"video_url": "https://x/y.mp4?Signature=abc"}, "created_at": 1700000000, "updated_at": 1700000050})
    put(tmp_path / "t/task_run.json", {"id": "2", "status": "running"})
    tasks = {r.id: r for r in io.task_status(spark, str(tmp_path / "t")).collect()}
    assert tasks["1"].video_url == "https://x/y.mp4" and tasks["1"].terminal and not tasks["2"].terminal
    assert "content" not in tasks["1"].asDict()
    put(tmp_path / "m/a.json", {"pet_id": "a", "saved_at": "2026-01-02T03:04:05+08:00", "migrated": True}, bom=True)
    put(tmp_path / "m/b.json", {"pet_id": "b", "saved_at": "2026-01-02T03:04:05+0800", "original_filename": None})
    found = {r.pet_id: r for r in io.source_manifest(spark, str(tmp_path / "m")).collect()}
    assert found["a"].saved_at == found["b"].saved_at and found["a"].migrated and found["b"].migrated is None


def test_tuning_configs_and_reports(spark, tmp_path):
    put(tmp_path / "p/one/tuning.json", {"provider": "one", "configs": [{"id": "a", "quality": {"pseudo_mae": 0.1}, "notes": ["x", "y"], "runtime": {"end_to_end_ms": 5}}, {"id": "b", "notes": "z", "quality": {"pseudo_mae": None}}], "recommendation": {"selected": "b"}})
    put(tmp_path / "p/two/tuning.json", {"provider": {"name": "two", "x": 1}, "configs": [{"id": "c", "status": "ok", "parameters": {"k": [1, "s"]}}], "recommendation": {"config_id": "", "id": "c"}})
    got = {r.id: r for r in io.tuning_configs(spark, str(tmp_path / "p/*/tuning.json")).collect()}
    assert (got["a"].provider, got["a"].notes, got["a"].pseudo_mae, got["a"].end_to_end_ms, got["a"].recommended) == ("one", "x; y", 0.1, 5.0, False)
    assert got["b"].notes == "z" and got["b"].pseudo_mae is None and got["b"].recommended
    assert got["c"].provider == "two" and got["c"].recommended and got["c"].status == "ok"
    put(tmp_path / "r/report.json", {"source_dir": "d", "providers": {"x": {"frames": 3, "missing": ["f1"], "mean": {"pseudo_mae": 0.5}}, "y": {"frames": 0}}})
    report = {r.provider: r for r in io.evaluation_report(spark, str(tmp_path / "r")).collect()}
    assert report["x"].pseudo_mae == 0.5 and report["x"].n_missing == 1 and report["y"].pseudo_mae is None and report["y"].n_missing == 0
    put(tmp_path / "c/catalogue.json", {"providers": {"x": {"display": "X", "vram_mb": None, "runtime_ms": 2}}})
    assert io.catalogue(spark, str(tmp_path / "c")).first().display == "X"


def png(pixels, width):
    channels = len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in pixels[i : i + width] for v in p) for i in range(0, len(pixels), width))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels) // width, 8, 2 if channels == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_frames(spark, tmp_path):
    (tmp_path / "clip=idle").mkdir()
    (tmp_path / "clip=idle/f_0001.png").write_bytes(png([(255, 0, 51), (0, 255, 0)], 2))
    (tmp_path / "clip=idle/f_0002.png").write_bytes(png([(10, 20, 30, 0), (40, 50, 60, 255)], 2))
    (tmp_path / "clip=idle/broken.png").write_bytes(b"\x89PNG no")
    found = io.frames(spark, str(tmp_path))
    px = {(r.name, r.x): (round(r.r * 255), round(r.g * 255), round(r.b * 255), round(r.a * 255)) for r in io.pixels(found).collect()}
    assert px[("f_0001.png", 0)] == (255, 0, 51, 255) and px[("f_0001.png", 1)] == (0, 255, 0, 255) and px[("f_0002.png", 1)][3] == 255 and len(px) == 4
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in io.file_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"f_0001.png": "png", "f_0002.png": "png", "broken.png": "png"}

    def opaque(pdf):
        pdf["data"] = [bytes(w * h * 4) for w, h in zip(pdf["width"], pdf["height"], strict=True)]
        pdf["n_channels"] = 4
        return pdf

    plugins.register_provider("opaque", opaque)
    plugins.register_provider("loses one", lambda pdf: opaque(pdf).iloc[1:])
    assert {r.error for r in plugins.run_provider("opaque", found).collect()} == {None}
    assert {r.error for r in plugins.run_provider("loses one", found).collect()} == {"names differ from the source"}
    io.write_report(found.select("name"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_provider_by_stretches(spark):
    """No call gets a whole long clip; neighbours are at hand at the ends of a stretch, facts are of the whole clip."""
    frames = spark.createDataFrame([("long", f"f_{i:04d}", 1, 1, 3, bytes([i % 256] * 3)) for i in range(200)] + [("short", "a", 1, 1, 3, b"\x07\x07\x07")], "clip string, name string, width int, height int, n_channels int, data binary")

    def by_stretch(pdf, known):
        v = [d[0] for d in pdf["data"]]
        near = [bytes([v[i - 1] if i else 0, v[i + 1] if i + 1 < len(v) else 0, known, len(v)]) for i in range(len(v))]
        return pdf.assign(data=near, n_channels=4)

    by_stretch.stretches = plugins.Stretches(4, len)
    plugins.register_provider("by stretch", by_stretch)
    got = sorted(plugins.run_provider("by stretch", frames).collect())
    assert [(r.clip, r.name, r.error) for r in got] == [("long", f"f_{i:04d}", None) for i in range(200)] + [("short", "a", None)]
    assert [tuple(r.data)[:3] for r in got] == [(max(0, i - 1), i + 1 if i < 199 else 0, 4) for i in range(200)] + [(0, 0, 1)]
    assert max(r.data[3] for r in got) == plugins.STRETCH + 2
