"""The subpackage's queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataform.llm import bpe, fill_middle, fingerprints, jaccard_join, license_scan, mixing, neighbours, quality_classifier, quality_rules, token_store, url_filter, warc, whitening

MODULES = {"op1_fingerprints": fingerprints, "op2_bpe": bpe, "op3_url_filter": url_filter, "op4_warc": warc, "op5_jaccard_join": jaccard_join, "op6_quality_classifier": quality_classifier, "op7_mixing": mixing, "op8_token_store": token_store, "op9_quality_rules": quality_rules, "op10_license_scan": license_scan, "op11_fill_middle": fill_middle, "op12_whitening": whitening, "op13_neighbours": neighbours}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
