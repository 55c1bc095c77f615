"""Query registry: each entry is a Spark callable plus its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.sources.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` as query ``name``.

    ``sql`` is the DuckDB oracle over the driver tables; ``views`` names the
    base views (``obs``, ``pred`` ...) its text refers to.  Queries without
    SQL get a rows-only check plus invariant tests in ``tests/``.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql.strip(), *views)
        return fn
    return deco
