"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reqlens.plans import (
    access_queries,
    alert_queries,
    dataset_queries,
    evaluation_queries,
    request_queries,
    sink_queries,
    stream_queries,
    training_queries,
)

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [
    request_queries,
    alert_queries,
    access_queries,
    dataset_queries,
    evaluation_queries,
    training_queries,
    stream_queries,
    sink_queries,
]


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
