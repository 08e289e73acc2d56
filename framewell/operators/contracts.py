"""Checks of tuning result files, and runtimes of differing shapes: both over VARIANT documents, which are not shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.operators.rules import MOST

# Fields of the result files.
QUALITY = ("pseudo_mae", "background_alpha_mean", "foreground_loss_mean", "green_fringe", "fragment_pct", "soft_alpha_pct")
RUNTIME = ("mean_inference_ms", "end_to_end_ms", "peak_vram_mb")
RECOMMENDATION = ("config_id", "recommended_config_id", "selected_config_id", "primary", "id")
LEAST_CONFIGS = 3


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _kind(v: Column) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...> ..., VOID for null and for what isn't there."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column) -> Column:
    """The text, null where v is none."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _items(v: Column, path: str) -> Column:
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(F.startswith(_kind(_at(v, path)), F.lit("ARRAY")), F.try_variant_get(v, path, "array<variant>")), none)


def _number_or_null(v: Column) -> Column:
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return (kind == "VOID") | (F.rlike(kind, F.lit("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")) & finite)


def _named(i: Column, of: str, rest: str) -> Column:
    return F.concat(F.lit(f"{of}["), i.cast("string"), F.lit(f"]{rest}"))


def _list(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages))


def _config_errors(c: Column, i: Column) -> Column:
    fields = [*((f"$.quality.{f}", f".quality.{f}") for f in QUALITY), *((f"$.runtime.{f}", f".runtime.{f}") for f in RUNTIME), ("$.temporal_alpha_mae", ".temporal_alpha_mae")]
    numbers = _list(*[F.when(~_number_or_null(_at(c, path)), _named(i, "configs", f"{name} must be finite number or null")) for path, name in fields])
    id_ = _text(_at(c, "$.id"))
    return F.when(~F.startswith(_kind(c), F.lit("OBJECT")), F.array(_named(i, "configs", " must be an object"))).when(F.coalesce(id_ == "", F.lit(True)), F.array(_named(i, "configs", ".id must be a non-empty string"))).otherwise(numbers)


def contract_errors(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(path, error): a row for each breach of the contract in docs (path, v): a result file's VARIANT, null where it is no JSON.

    provider is a text or an object with a name; official_docs has addresses; three configurations at least, each an
    object with an id of its own; metrics are finite or null; the recommendation is a known id. existing: the table
    (output_dir) of folders that are there, which makes the check strict: folders of configurations with status ok must be
    among them. An empty table has no errors.
    """
    v, configs, ids = F.col("v"), F.col("configs"), F.col("ids")
    provider = F.coalesce(_text(_at(v, "$.provider.name")), _text(_at(v, "$.provider")))
    sources = _items(v, "$.official_docs")
    addresses = F.transform(sources, lambda d, i: F.when(~F.coalesce(F.startswith(_text(_at(d, "$.url")), F.lit("http")), F.lit(False)), _named(i, "official_docs", " must contain an HTTP(S) url")))
    id_of = lambda c: F.when(F.startswith(_kind(c), F.lit("OBJECT")), F.nullif(_text(_at(c, "$.id")), F.lit("")))
    # ids in order, each beside the one before it: a file's work grows with its configurations, not with their square
    read = docs.select("path", "v", _items(v, "$.configs").alias("configs")).select("*", F.array_sort(F.array_compact(F.transform(configs, id_of))).alias("ids"))
    before = F.concat(F.array(F.lit(None).cast("string")), ids)
    repeated = F.zip_with(ids, before, lambda x, y: F.when(x == y, F.concat(F.lit("duplicate config id: "), x)))
    recommended = F.coalesce(*[F.nullif(_text(_at(v, f"$.recommendation.{k}")), F.lit("")) for k in RECOMMENDATION])
    unknown = F.when(recommended.isNotNull() & ~F.array_contains(ids, recommended), F.concat(F.lit("recommendation references unknown config: "), recommended))
    n = F.size(configs)
    whole = _list(
        F.when(F.coalesce(F.trim(provider) == "", F.lit(True)), F.lit("provider must be a non-empty string")),
        F.when(F.size(sources) == 0, F.lit("official_docs must contain at least one item")),
        F.when(n == 0, F.lit("configs must contain at least one configuration")),
        F.when(n < LEAST_CONFIGS, F.concat(F.lit(f"expected at least {LEAST_CONFIGS} configurations, got "), n.cast("string"))),
        unknown,
    )
    of_file = F.when(v.isNull(), F.array(F.lit("not a JSON document"))).otherwise(F.concat(whole, F.array_compact(addresses), F.array_compact(repeated)))
    each = docs.select("path", F.posexplode(_items(v, "$.configs")).alias("i", "c"))
    out = read.select("path", F.explode(of_file).alias("error")).unionByName(each.select("path", F.explode(_config_errors(F.col("c"), F.col("i"))).alias("error")))
    if existing is None:
        return out
    each = each.select("path", "i", _text(_at(F.col("c"), "$.status")).alias("status"), F.nullif(_text(_at(F.col("c"), "$.output_dir")), F.lit("")).alias("output_dir"), F.nullif(_text(_at(F.col("c"), "$.id")), F.lit("")).alias("id"))
    lost = each.where("status = 'ok' and output_dir is not null and id is not null").join(existing.select("output_dir").distinct(), "output_dir", "left_anti")
    return out.unionByName(lost.select("path", F.concat(_named(F.col("i"), "configs", ".output_dir does not exist: "), F.col("output_dir")).alias("error")))


RUNTIME_FIELDS = ("task_seconds", "core_seconds", "inference_ms", "frame_ms", "vram_mb")
SHAPE = "provider string, field string, path string, factor double, per_frame boolean, constant double"


def _shape(provider: str, **fields) -> list[tuple]:
    """Rows of one provider. A field: a path, or paths that are added, each with a factor (1 if none); `/frame` divides by the frames; a number is a constant."""
    out = []
    for name, value in fields.items():
        for part in value if isinstance(value, list) else [value]:
            path, factor, per = (part, 1.0, False) if isinstance(part, str) else (None, 0.0, False) if isinstance(part, float) else (part[0], float(part[1]), len(part) > 2)
            out.append((provider, name, path and f"$.{path}", factor, per, part if isinstance(part, float) else None))
    return out


# Where each kind of metrics file has its runtimes, and the unit.
_FLAT = {"task_seconds": "total_seconds", "core_seconds": "total_seconds", "frame_ms": "mean_ms_per_frame", "vram_mb": 0.0}
_LOADED = {
    "task_seconds": ["model_load_seconds", "batch_wall_seconds"], "core_seconds": "batch_wall_seconds", "inference_ms": ("inference_mean_excluding_first_seconds", 1000),
    "frame_ms": ("end_to_end_mean_excluding_first_seconds", 1000), "vram_mb": ("cuda_peak_memory.allocated_bytes", 1 / 1048576),
}
RUNTIME_SHAPES = [
    *_shape("adaptive_green_baseline", **_FLAT), *_shape("adaptive_green_edge_v2", **_FLAT), *_shape("adaptive_green_temporal_v3", **_FLAT),
    *_shape("ben2", task_seconds=[("summary.model_load_ms", 1e-3), ("summary.warmup_total_ms", 1e-3), ("summary.measured_wall_ms", 1e-3)], core_seconds=("summary.measured_wall_ms", 1e-3), inference_ms="summary.inference_mean_excluding_first_ms", frame_ms="summary.mean_total_ms", vram_mb="summary.max_cuda_pipeline_peak_allocated_mib"),
    *_shape("ZhengPeng7/BiRefNet (General)", **_LOADED), *_shape("ZhengPeng7/BiRefNet-matting", **_LOADED),
    *_shape("paddle_matting", task_seconds="process_seconds_excluding_cli_import", core_seconds="measured_seconds", inference_ms="mean_inference_ms", frame_ms="mean_total_ms", vram_mb="peak_vram_mb"),
    *_shape("rembg", task_seconds="run_wall_seconds", core_seconds="batch_wall_seconds", inference_ms=("remove_mean_excluding_first_seconds", 1000), frame_ms=("end_to_end_mean_excluding_first_seconds", 1000)),
    *_shape("official_meta_sam2_1_small_video", task_seconds="timing.end_to_end_seconds", core_seconds="timing.inference.propagation_wall_seconds", inference_ms=("timing.inference.propagation_wall_seconds", 1000, "/frame"), frame_ms=("timing.inference.propagation_wall_seconds", 1000, "/frame"), vram_mb="timing.inference.peak_memory.peak_allocated_mib"),
    *_shape("official_matanyone_v1", task_seconds="timing.end_to_end_seconds", core_seconds="timing.output_inference_seconds", inference_ms=("timing.output_inference_seconds", 1000, "/frame"), frame_ms=("timing.output_inference_seconds", 1000, "/frame"), vram_mb="timing.cuda_peak_during_inference.peak_allocated_mib"),
    *_shape("vitmatte_adaptive_green_hybrid", task_seconds=["model_load_seconds", "green_profile_seconds", "batch_wall_seconds"], core_seconds="batch_wall_seconds", inference_ms=("inference_mean_excluding_first_seconds", 1000), frame_ms=("end_to_end_mean_seconds", 1000), vram_mb=("cuda_memory.peak_allocated_bytes", 1 / 1048576)),
]


def runtime_shapes(spark: SparkSession, rows: Sequence[tuple] = RUNTIME_SHAPES) -> DataFrame:
    return spark.createDataFrame(list(rows), SHAPE)


def harmonised(runs: DataFrame, shapes: DataFrame) -> DataFrame:
    """runs plus task_seconds, core_seconds, inference_ms, frame_ms and vram_mb.

    runs: provider, frame_count, v (the metrics file's VARIANT) and others. shapes: a row for each path that makes up
    a provider's field; users add rows. Values of a field are added; one that is no number makes it null, as does a
    field without rows. A provider without rows is an error, a null one as well.
    """
    if shapes.count() > MOST:
        raise ValueError(f"more than {MOST} rows of shapes")
    part = F.struct("path", "factor", "per_frame", "constant")
    by_field = shapes.groupBy("provider", "field").agg(F.collect_list(part).alias("parts"))
    known = by_field.groupBy("provider").agg(F.map_from_entries(F.collect_list(F.struct("field", "parts"))).alias("_shape"))
    both = runs.join(F.broadcast(known), "provider", "left").withColumn("_shape", F.coalesce("_shape", F.raise_error(F.concat(F.lit("no runtime shape for "), F.coalesce("provider", F.lit("null"))))))

    def value(p: Column) -> Column:
        found = F.try_variant_get(F.col("v"), p["path"], "double") * p["factor"]
        return F.coalesce(p["constant"], F.when(p["per_frame"], F.try_divide(found, F.col("frame_count").cast("double"))).otherwise(found))

    def field(name: str) -> Column:
        parts = F.col("_shape")[name]
        return F.when(parts.isNotNull(), F.aggregate(F.transform(parts, value), F.lit(0.0), lambda s, x: s + x))

    return both.select(*runs.columns, *[field(n).alias(n) for n in RUNTIME_FIELDS])
