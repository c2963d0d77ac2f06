"""Named queries, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollmill.session import table


class Tables:
    """The tables of one folder, read when asked for: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Registers a function of ``Tables`` as the query ``name``."""

        def add(make: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return make

        return add
