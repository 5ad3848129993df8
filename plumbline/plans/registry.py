"""Registry of the assurance queries: one entry per operator, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "exact_dup_groups"

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: puts a query of (spark, directory) and its SQL into the registry."""

    def put(query: Callable) -> Callable:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def _load() -> None:
    from plumbline.plans import assurance_queries, dataset_queries, forensic_queries, model_queries, record_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
