"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import importlib

#: query name -> module of this package that defines it
MODULES = {
    "op1_brown_lm": "brown",
    "op6_near_duplicates": "jaccard",
    "op5_nearest_neighbours": "neighbours",
    "op7_html_text": "html_text",
    "op2_sentencepiece": "pieces",
    "op10_language_id": "language",
    "op4_quality_classifier": "classifier",
    "op3_mix_sources": "mixing",
    "op8_quality_rules": "quality_rules",
    "op9_kd_sharding": "sharding",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"fronda.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"fronda.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
