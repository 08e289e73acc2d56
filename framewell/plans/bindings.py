"""Registered queries over the driver tables."""

from framewell.plans import registry
from framewell.plans import clip_queries, comparison_queries, contract_queries, matte_queries, parts_queries, pixel_queries, stream_queries, telemetry_queries, tuning_queries  # noqa: F401  they register themselves


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
