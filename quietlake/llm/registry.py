"""Queries and SQL of the operators in this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> function) and ORACLE_SQL (name -> DuckDB SQL).
MODULES = (
    "token_attribution",
    "simhash",
    "language",
    "packing",
    "sharding",
    "bpe",
    "pii",
    "cover_tree",
    "additive_ann",
    "paragraph_dedup",
    "sentence_bpe",
    "collocations",
    "conversation_repair",
)


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"quietlake.llm.{m}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
