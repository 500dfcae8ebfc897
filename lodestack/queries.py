"""Registered queries over the test tables, and the DuckDB SQL of each."""

from __future__ import annotations

from lodestack.plans import q_files, q_lookups, q_more, q_ops, q_retrieval

_FAMILIES = (q_retrieval, q_files, q_ops, q_lookups, q_more)
QUERIES: dict = {k: f for m in _FAMILIES for k, f in m.Q.items()}
ORACLE_SQL: dict[str, str] = {k: x for m in _FAMILIES for k, x in m.SQL.items()}
