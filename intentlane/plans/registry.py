"""Key -> DataFrame job over the driver's tables (the ``queries()`` contract).

Every job reads whole tables from ``sf_dir`` and returns a DataFrame with
aliased, flat, scalar columns so results compare by name and value."""

from __future__ import annotations

from collections.abc import Callable

import functools

from pyspark.sql import DataFrame, SparkSession

from intentlane.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[key] = run
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # importing the modules fills QUERIES
    from intentlane.plans import queries_catalog, queries_core, queries_gov  # noqa: F401
    return dict(QUERIES)
