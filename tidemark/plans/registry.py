"""All registered queries and their oracle SQL."""

from __future__ import annotations

from tidemark.plans import changes, files, graphs, logs, retrieval, streams, texts

MODULES = (changes, graphs, texts, retrieval, logs, files, streams)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
