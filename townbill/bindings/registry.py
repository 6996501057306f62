"""Registered queries: each binds an operator to the given tables, with SQL for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from townbill.session import pin_session

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name; `sql` states the same result."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")

