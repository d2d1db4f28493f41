"""Registered queries of the rating engine, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tunegrid.plans.oracle import duck
from tunegrid.sources.adapter import Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Catalogue], DataFrame], sql: str | None = None, **views: str) -> None:
    """build gets the domain views of a folder; sql is the DuckDB counterpart, None where SQL cannot tell."""
    QUERIES[name] = lambda spark, sf_dir: build(Catalogue(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = duck(sql, **views)


from tunegrid.plans import analysis, catalogue, evaluation, extra, flows, models, recommend, rendered, stores, upkeep  # noqa: E402, F401
