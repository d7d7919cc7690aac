"""Registries: queries with their SQL oracles, and named operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, Callable] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a (spark, sf_dir) query, with DuckDB SQL for the same rows where SQL can say it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def operator(name: str) -> Callable[[Callable], Callable]:
    """Register a plug-in (tracker, motion model, source, ...) to be made by ``build``."""

    def add(f: Callable) -> Callable:
        OPERATORS[name] = f
        return f

    return add


def build(config: dict):
    """The operator that ``config['type']`` names, made with the other entries."""
    from trackmill.operators import tracking  # noqa: F401  registers the library's own

    options = dict(config)
    name = options.pop("type")
    if name not in OPERATORS:
        raise KeyError(f"no operator {name!r}; known: {', '.join(sorted(OPERATORS))}")
    return OPERATORS[name](**options)
