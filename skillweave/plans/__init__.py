"""Registered queries of the core, with their SQL."""

from __future__ import annotations

from skillweave.plans import analytics, browse, cascade, compare, documents, links, problems, skills, streams

_MODULES = (problems, skills, links, analytics, streams, cascade, compare, browse, documents)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
