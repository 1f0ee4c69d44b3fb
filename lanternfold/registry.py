"""A registry of queries: each is a plan over the tables of a folder, with the SQL that gives the same rows."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one folder, opened when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}
        self.made: dict[str, Callable[[Tables], DataFrame]] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Register a function from Tables to a DataFrame under ``name``; ``sql``: the same rows in SQL, if it can express them."""

        def put(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.plans:
                raise ValueError(f"two queries are named {name}")
            self.plans[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
            self.made[name] = plan
            if sql is not None:
                self.sql[name] = textwrap.dedent(sql).strip()
            return plan

        return put
