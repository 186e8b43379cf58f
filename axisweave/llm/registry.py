"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from axisweave.llm import decontaminate, langid, lm, mixing, neardup, quality, sharding, substring, tokenstore, toxicity

_MODULES = {
    "op1_quality_rules": quality,
    "op2_substring_dedup": substring,
    "op3_lm_scores": lm,
    "op4_decontaminate": decontaminate,
    "op5_source_mix": mixing,
    "op6_toxicity": toxicity,
    "op7_near_duplicates": neardup,
    "op8_token_store": tokenstore,
    "op9_sharding": sharding,
    "op10_language_id": langid,
}


def queries() -> dict:
    return {**{name: module.query for name, module in _MODULES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
