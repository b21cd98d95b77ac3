"""Every query of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query and the module that holds it.
MODULES = {
    "op1_exact_top_k": "topk",
    "op2_simhash_near_dedup": "simhash",
    "op3_sentencepiece_sampling": "pieces",
    "op4_source_mix": "mixing",
    "op5_language_id": "langid",
    "op6_quality_rules": "quality",
    "op7_pii": "pii",
    "op8_toxicity": "toxicity",
    "op9_secret_scan": "secrets",
    "op10_token_records": "records",
    "op11_fill_in_middle": "fim",
    "op12_best_fit_packing": "packing",
    "op13_hard_negatives": "negatives",
}


def queries() -> dict:
    return {name: getattr(import_module(f"glyphmill.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"glyphmill.llm.{module}"), "ORACLE_SQL", {}).get(name) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
