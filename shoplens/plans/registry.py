"""Registry of named queries.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Queries whose result
is plain SQL-expressible also carry the equivalent DuckDB SQL over the given
tables (the oracle); the others are checked by row count and by tests.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from shoplens.plans import (  # noqa: F401
        q_catalog, q_events, q_profiles, q_behavior, q_recommend, q_profiling, q_reports, q_sources,
        q_streams,
    )


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
