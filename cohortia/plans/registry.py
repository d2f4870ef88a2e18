"""All queries outside the optional subpackage: name -> callable, name -> SQL.

A plan module registers its queries with `query`; the modules are named in MODULES.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("sources", "scalars", "gates", "joins", "aggregates", "windows", "sequences", "models", "streams")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable of (spark, sf_dir) under `name`, with SQL where there is an equivalent."""

    def put(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _name in MODULES:
    import_module(f"cohortia.plans.{_name}")
