"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that defines ``query(spark, sf_dir)`` and perhaps ``SQL``.
MODULES = {
    "op1_license_scan": "license_scan",
    "op2_winnow_fingerprints": "fingerprint",
    "op3_source_mixing": "mixing",
    "op4_secret_scan": "secret_scan",
    "op5_token_counts": "token_count",
    "op6_warc_round_trip": "warc",
    "op7_toxicity": "toxicity",
    "op8_embedding_near_dedup": "embedding_dedup",
    "op9_bpe_round_trip": "bpe",
    "op10_ngram_jaccard_join": "ngram_join",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{m}"), "SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
