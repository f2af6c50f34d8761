"""The library's queries by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (views) as a query."""

    def add(f):
        from memloom.plans.views import Views

        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of activation queries over the entity graph."""
    return QUERIES["r01_graph_query"](spark, sf_dir)


from memloom.plans import queries_graph, queries_hybrid, queries_ledger, queries_recall, queries_store, queries_text  # noqa: E402, F401
