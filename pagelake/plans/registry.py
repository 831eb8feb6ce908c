"""Named queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from .fixtures import Tables, with_views

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return register


def same_rows_as(name: str):
    """Register a function of Tables that takes another way to the rows of an earlier query, whose SQL holds for both."""

    def register(f: Callable) -> Callable:
        query()(f)
        _SQL[f.__name__] = _SQL[name]
        return f

    return register


def _load() -> None:
    from . import boxes, clusters, joins, reports, sources, streams, strips, texts  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
