"""Registry of the core queries: key -> query and key -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Text of each query that is one, and the views it computes once.
texts: dict[str, tuple[str, tuple[str, ...]]] = {}


def register(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: put a (spark, sf_dir) query, and its DuckDB SQL if any, under a key."""

    def keep(query: Query) -> Query:
        if key in _QUERIES:
            raise ValueError(f"query key {key} is taken")
        _QUERIES[key] = query
        if oracle:
            _ORACLES[key] = oracle
        return query

    return keep


def queries() -> dict[str, Query]:
    from graintide import plans

    plans.load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from graintide import plans

    plans.load()
    return dict(_ORACLES)


def known_oracles() -> dict[str, str]:
    """The SQL of the modules imported so far, for queries made of others."""
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["spec_curve"](spark, sf_dir)
