"""Named queries with their independent SQL, collected from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from docweave.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; ``sql`` is the equivalent statement on the same tables, where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is defined twice")

            @wraps(function)
            def query(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return function(spark, folder)

            self.queries[name] = query
            if sql:
                self.oracle[name] = sql
            return function

        return register
