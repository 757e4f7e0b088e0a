"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: query -> (module, SQL it is held against or None)
_QUERIES = {
    "op1_mix_sources": "mixing",
    "op2_chat_format": "chat",
    "op3_license_scan": "licenses",
    "op4_personal_data": "pii",
    "op5_quality_rules": "quality_rules",
    "op6_quality_model": "quality_model",
    "op7_near_dedup": "near_dedup",
    "op8_bpe_round_trip": "bpe",
    "op9_language_id": "langid",
    "op10_exact_dedup": "exact_dedup",
    "op11_bit_clusters": "bit_clusters",
    "op12_url_filter": "url_filter",
    "op13_filter_audit": "filter_audit",
}


def _module(name: str):
    return importlib.import_module(f"segmentry.llm.{name}")


def queries() -> dict:
    found = {query: getattr(_module(module), query) for query, module in _QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {q: _module(m).ORACLE for q, m in _QUERIES.items() if hasattr(_module(m), "ORACLE")}
