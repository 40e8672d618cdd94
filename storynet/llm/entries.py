"""The queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from importlib import import_module

#: Module to query name.
_MODULES: dict[str, str] = {
    "url_filter": "op1_url_filter",
    "jaccard_join": "op2_jaccard_join",
    "chat_format": "op3_chat_format",
    "top_k": "op4_top_k",
    "language": "op5_language",
    "pii": "op6_pii",
    "decontaminate": "op7_decontaminate",
    "mixing": "op8_mixing",
    "quality": "op9_quality",
    "suffix_dedup": "op10_suffix_dedup",
    "centroids": "op11_centroids",
    "hard_negatives": "op12_hard_negatives",
    "hash_forest": "op13_hash_forest",
}

QUERIES = {name: import_module(f"storynet.llm.{module}").query for module, name in _MODULES.items()}
SQL = {
    name: sql
    for module, name in _MODULES.items()
    if (sql := getattr(import_module(f"storynet.llm.{module}"), "SQL", None))
}
