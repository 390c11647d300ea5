"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

#: query -> module that defines it; a module's SQL is its dictionary ORACLE_SQL, where it has one.
MODULES = {
    "op4_surrogates": "surrogates",
    "op5_gumbel_resampling": "quality",
    "op6_imatch": "imatch",
    "op8_tree_bpe": "bpe",
    "op1_best_fit": "packing",
    "packing_capacities": "packing",
    "op3_elias_fano": "tokenfile",
    "op9_simhash_gray": "simhash",
    "op10_va_file": "vafile",
    "op2_bloom_cascade": "urlfilter",
    "op7_jump_hash": "sharding",
    "op11_jaccard_regions": "jaccard",
    "op12_filter_audit": "audit",
    "op13_target_resampling": "target",
}


def _module(name: str):
    return import_module(f"quern.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "ORACLE_SQL", {}).get(name) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
