"""Operators for preparing training text; see the README for the list.

Each module holds one operator with a general interface, the thin query that
applies it to the whole ``documents`` table, and the query's DuckDB SQL where
SQL can express it.  Nothing outside this subpackage imports it.
"""

from __future__ import annotations

from importlib import import_module

#: Query name -> module.  Modules are imported when their query is asked for.
QUERIES = {
    "op5_toxicity": "toxicity",
    "op6_lm_score": "lm_score",
    "op7_suffix_dedup": "substring_dedup",
    "op8_quality_rules": "quality_rules",
    "op1_minmax_dedup": "near_dedup",
    "op2_license_scan": "license_scan",
    "op3_language_id": "language_id",
    "op4_fingerprints": "fingerprints",
    "op9_best_fit_packing": "packing",
    "op10_bpe_automaton": "bpe_automaton",
}


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {name: import_module(f"{__name__}.{module}").query for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, for the queries SQL can express."""
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
