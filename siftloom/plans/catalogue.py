"""The query catalogue: name -> query, and its SQL twin where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftloom.plans import eval_queries, io_queries, text_queries
from siftloom.session import ship_package

MODULES = (text_queries, eval_queries, io_queries)


def _shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    return run


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.queries()
    return {name: _shipped(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out
