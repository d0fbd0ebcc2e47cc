"""Names of the library's own queries, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "j3_flip_rate"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query under `name`, with its oracle if there is one."""

    def add(function):
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return add


def _load() -> None:
    """The modules of veilspan.plans register their queries when imported."""
    from veilspan.plans import analysis, core, operators  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v() if callable(v) else v for k, v in _ORACLES.items()}
