"""Registry of named queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from peakloom.plans.bindings import Tables, with_views
from peakloom.session import reach_workers


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(fn, with_views(sql) if sql else None)
        return fn

    return wrap


def spark_callable(key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: REGISTRY[key].run(Tables(reach_workers(spark), sf_dir))
