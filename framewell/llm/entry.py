"""The queries of this subpackage, one for each operator and the pipeline, and the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline
from framewell.llm import decontaminate, fill_in_middle, language_id, license_scan, ngram_join, packing, quality_rules, resampling, secrets_scan, sharding, substring_dedup, token_files, url_filter


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_token_files": token_files.op5_token_files,
        "op6_language_id": language_id.op6_language_id,
        "op7_secrets": secrets_scan.op7_secrets,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_packing": packing.op9_packing,
        "op10_sharding": sharding.op10_sharding,
        "op11_license_scan": license_scan.op11_license_scan,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.SQL,
        "op2_decontaminate": decontaminate.SQL,
        "op3_ngram_join": ngram_join.SQL,
        "op4_url_filter": url_filter.SQL,
        "op8_quality_rules": quality_rules.SQL,
        "op11_license_scan": license_scan.SQL,
        "op12_importance_resampling": resampling.SQL,
        "op13_fill_in_middle": fill_in_middle.SQL,
    }
