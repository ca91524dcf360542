"""Registry of runnable queries, each with its operator ids and its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarnscope.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    run: QueryFn
    sql: str | None
    module: str


REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name`` for the operator ids in ``rows``."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        REGISTRY[name] = Query(name, tuple(rows.split()), run, sql, fn.__module__)
        return fn

    return wrap


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
