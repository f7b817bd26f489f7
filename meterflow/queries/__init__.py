"""Registered queries of the library, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import billing, documents, identity, records, sources, usage

MODULES = (usage, billing, identity, documents, sources, records)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
