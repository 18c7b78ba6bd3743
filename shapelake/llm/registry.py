"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from shapelake.llm import q_alignment, q_chat, q_lines, q_mixing, q_near, q_negatives, q_neighbours, q_packing, q_quality, q_quality_pu, q_secrets, q_substrings, q_url

MODULES = (
    q_neighbours, q_substrings, q_secrets, q_chat, q_lines, q_near, q_packing, q_mixing, q_quality, q_url,
    q_quality_pu, q_negatives, q_alignment,
)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
