"""The registered queries: each a DataFrame plan, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ["marker_plans", "clean_plans", "pair_plans", "text_plans", "record_plans", "stream_plans", "measure_plans", "evidence_plans"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__name__}.{m}").SQL.items()}
