"""Operators for training data. Nothing else in the library imports this package."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_ngram_jaccard": "op1_ngram_jaccard",
    "op2_substring_dedup": "op2_substring_dedup",
    "op3_toxicity": "op3_toxicity",
    "op4_exact_dedup": "op4_exact_dedup",
    "op5_sharding": "op5_sharding",
    "op6_token_binary": "op6_token_binary",
    "op7_embedding_neardup": "op7_embedding_neardup",
    "op8_license_scan": "op8_license_scan",
    "op9_packing": "op9_packing",
    "op10_bpe": "op10_bpe",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__name__}.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: importlib.import_module(f"{__name__}.{module}").ORACLE for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
