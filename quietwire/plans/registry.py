"""Registered queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quietwire.plans.driver_views import Views, oracle_ctes, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of the views as a query; ``sql`` is its oracle, over the same views and further ``ctes``."""

    def register(function: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: function(views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {oracle_ctes()}{', ' + ctes if ctes else ''}\n{sql}"
        return function

    return register
