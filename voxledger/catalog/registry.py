"""Collects queries and their SQL twins by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxledger.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.twins: dict[str, str] = {}

    def query(self, key: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query; without ``sql`` only its rows can be checked."""

        def add(run: Query) -> Query:
            self.queries[key] = lambda spark, sf_dir: run(prepare(spark), sf_dir)
            if sql is not None:
                self.twins[key] = sql
            return run

        return add


registry = Registry()
query = registry.query
