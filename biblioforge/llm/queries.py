"""Queries and SQL of this subpackage, gathered."""

from __future__ import annotations

import importlib

_MODULES = ("queries_groups", "queries_names", "queries_matching", "queries_encoding", "queries_places", "queries_tokens", "queries_truncation")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"biblioforge.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
