"""Registry of queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ("columns", "sessions", "joins", "rollups", "features", "live", "metrics", "files", "models",
           "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"gridpulse.plans.queries_{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
