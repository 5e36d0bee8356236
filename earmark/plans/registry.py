"""Registry of runnable queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    covers: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function (spark, folder) under its own name; ``covers`` are inventory ids."""

    def add(run: Run) -> Run:
        if run.__name__ in QUERIES:
            raise ValueError(f"query {run.__name__} exists")
        QUERIES[run.__name__] = Query(run.__name__, run, covers, sql)
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> dict[str, Query]:
    """Import every query module, then return the registry."""
    from earmark.plans import (  # noqa: F401
        ablation_queries, column_queries, incremental_queries, merging_queries, run_queries, sampling_queries,
        search_queries, source_queries, workflow_queries,
    )

    return QUERIES
