"""Readers of run telemetry, task status, manifests, tuning results, reports and frames.

Schemas are explicit; only fields that drift stay VARIANT. An unreadable file is an error row, not a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = ("stylize", "state_sheet", "state_frame", "animate", "matte")
TASK = "id string, model string, status string, content struct<video_url: string>, usage struct<completion_tokens: long, total_tokens: long>, created_at long, updated_at long, seed long, resolution string, ratio string, duration int, framespersecond int, service_tier string, execution_expires_after long, generate_audio boolean, draft boolean, priority int"
SOURCE = "pet_id string, input_file string, original_filename string, saved_as string, saved_at string, migrated boolean"
REPORT = "source_dir string, providers map<string, struct<frames: int, missing: array<string>, mean: struct<pseudo_mae: double, background_alpha_mean: double, foreground_loss_mean: double, green_fringe: double, opaque_green_leak_pct: double, soft_alpha_pct: double, coverage_pct: double, fragment_pct: double, fragment_count: double>, temporal_alpha_mae: double, runtime: map<string, double>>>"
CATALOGUE = "providers map<string, struct<display: string, recommended_config: string, role: string, status: string, license: string, runtime_ms: double, runtime_scope: string, vram_mb: double, source: string, finding: string>>"


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, v): each file as a VARIANT, null where it is no JSON."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.call_function("try_parse_json", F.regexp_replace("value", "^﻿", "")).alias("v"))


def _get(path: str, kind: str, of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def step_events(spark: SparkSession, path: str) -> DataFrame:
    """(pet_id, step, ord, key, clip, model, seconds, total_tokens, detail, error) of metrics.json files, a row for each step event. The pet is the folder's name."""
    docs = _documents(spark, path).withColumn("pet_id", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    step = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), _get(f"$.{s}", "array<variant>").alias("rows")) for s in STEPS]))
    rows = docs.where("v is not null").select("pet_id", step.alias("s")).select("pet_id", "s.step", F.posexplode("s.rows").alias("ord", "detail"))
    clip, file = F.nullif(_get("$.clip", "string", "detail"), F.lit("")), F.nullif(_get("$.file", "string", "detail"), F.lit(""))
    events = rows.select(
        "pet_id", "step", "ord", F.coalesce(F.concat(F.lit("clip:"), clip), F.concat(F.lit("file:"), file), F.concat(F.lit("ord:"), F.col("ord").cast("string"))).alias("key"), clip.alias("clip"),
        _get("$.model", "string", "detail").alias("model"), _get("$.seconds", "double", "detail").alias("seconds"), _get("$.usage.total_tokens", "long", "detail").alias("total_tokens"), "detail", F.lit(None).cast("string").alias("error"),
    )
    broken = docs.where("v is null").select("pet_id", F.lit("unreadable").alias("error"))
    return events.unionByName(broken, allowMissingColumns=True)


def strip_query(url: Column) -> Column:
    """Addresses lose their signature on the way in."""
    return F.regexp_replace(url, r"\?.*$", "")


def task_status(spark: SparkSession, path: str) -> DataFrame:
    """Task files, times as timestamps, the result's address without its query."""
    rows = spark.read.schema(TASK).option("multiLine", True).json(path)
    return rows.withColumns({"video_url": strip_query(F.col("content.video_url")), "created_at": F.timestamp_seconds("created_at"), "updated_at": F.timestamp_seconds("updated_at"), "terminal": F.col("status").isin("succeeded", "failed", "cancelled")}).drop("content")


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Source manifests, with or without a byte order mark; both offset styles of saved_at."""
    rows = spark.read.schema(SOURCE).option("multiLine", True).json(path)
    at = F.coalesce(F.try_to_timestamp("saved_at", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp("saved_at", F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))
    return rows.withColumn("saved_at", at)


def tuning_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configurations of tuning result files: provider as text or object, notes as text or list."""
    docs = _documents(spark, path).where("v is not null")
    provider = F.coalesce(_get("$.provider.name", "string"), F.when(F.schema_of_variant("v").isNotNull(), _get("$.provider", "string")))
    recommended = F.coalesce(*[F.nullif(_get(f"$.recommendation.{k}", "string"), F.lit("")) for k in ("config_id", "id", "recommended_config", "selected", "config")])
    rows = docs.select("path", provider.alias("provider"), recommended.alias("recommended"), F.posexplode(_get("$.configs", "array<variant>")).alias("ord", "c"))
    metrics = ("pseudo_mae", "green_fringe", "opaque_green_leak_pct", "background_alpha_mean", "foreground_loss_mean", "soft_alpha_pct")
    return rows.select(
        "path", "provider", "ord", _get("$.id", "string", "c").alias("id"), _get("$.status", "string", "c").alias("status"), (_get("$.id", "string", "c") == F.col("recommended")).alias("recommended"),
        F.coalesce(F.array_join(_get("$.notes", "array<string>", "c"), "; "), _get("$.notes", "string", "c")).alias("notes"), *[_get(f"$.quality.{m}", "double", "c").alias(m) for m in metrics],
        _get("$.temporal_alpha_mae", "double", "c").alias("temporal"), _get("$.runtime.mean_inference_ms", "double", "c").alias("mean_inference_ms"), _get("$.runtime.end_to_end_ms", "double", "c").alias("end_to_end_ms"), _get("$.parameters", "variant", "c").alias("parameters"),
    )


def evaluation_report(spark: SparkSession, path: str) -> DataFrame:
    """A row for each provider of report files."""
    rows = spark.read.schema(REPORT).option("multiLine", True).json(path)
    return rows.select("source_dir", F.explode("providers").alias("provider", "r")).select("source_dir", "provider", "r.frames", F.size(F.coalesce("r.missing", F.array().cast("array<string>"))).alias("n_missing"), "r.mean.*", "r.temporal_alpha_mae", "r.runtime")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CATALOGUE).option("multiLine", True).json(path)
    return rows.select(F.explode("providers").alias("provider", "c")).select("provider", "c.*")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(clip, name, width, height, n_channels, data) of image files under clip=... folders; bytes are BGR or BGRA. Files that are no images are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    name = F.regexp_extract("image.origin", "([^/]+)$", 1)
    clip = F.col("clip") if "clip" in images.columns else F.regexp_extract("image.origin", "([^/]+)/[^/]+$", 1)
    return images.select(clip.cast("string").alias("clip"), name.alias("name"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def pixels(found: DataFrame) -> DataFrame:
    """(clip, name, y, x, r, g, b, a) in 0..1 of 3- and 4-channel frames; Arrow does the unpacking, a batch of frames at a time."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(r.data, np.uint8).reshape(-1, r.n_channels) / 255.0
                at = np.arange(len(v))
                yield pd.DataFrame({"clip": r.clip, "name": r.name, "y": at // r.width, "x": at % r.width, "r": v[:, 2], "g": v[:, 1], "b": v[:, 0], "a": v[:, 3] if r.n_channels == 4 else 1.0})

    schema = T._parse_datatype_string("clip string, name string, y int, x int, r double, g double, b double, a double")
    return found.where("n_channels in (3, 4)").mapInPandas(run, schema)


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, sha256) of binary files: the kind by extension, else by the first bytes, else jpg."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.replace(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("jpeg"), F.lit("jpg"))
    head = F.hex(F.substring("content", 1, 12))
    magic = F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpg").when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "webp").when(F.substring(head, 9, 8) == "66747970", "heic")
    kind = F.when(ext.isin("jpg", "png", "webp", "heic"), ext).otherwise(F.coalesce(magic, F.lit("jpg")))
    return files.select("path", "length", kind.alias("kind"), F.sha2("content", 256).alias("sha256"))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; what is there goes."""
    df.write.mode("overwrite").json(path)
