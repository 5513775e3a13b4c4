"""The tables of one run, and the marts made of them, each stored at its first use and read by all that follow."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources.staging import stored


class Workspace:
    """tables: raw tables by name, or the folder that holds them as Parquet."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | str):
        self.spark, self.tables = spark, tables
        self.marts: dict[str, DataFrame] = {}
        self.given: set[str] = set()

    def give(self, name: str, df: DataFrame) -> None:
        """A mart that comes with the tables and isn't derived from them."""
        self.marts[name] = df
        self.given.add(name)

    def table(self, name: str) -> DataFrame:
        if isinstance(self.tables, str):
            return self.spark.read.parquet(f"{self.tables}/{name}.parquet")
        return self.tables[name]

    def mart(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.marts:
            self.marts[name] = stored(build(), f"mart-{name}")
        return self.marts[name]


#: Where queries read: a folder of tables, or a workspace that shares what they derive.
Source = str | Workspace


def mart(f: Callable[[SparkSession, Source], DataFrame]) -> Callable[[SparkSession, Source], DataFrame]:
    """A derived table of (spark, source); a workspace makes it once."""

    @wraps(f)
    def build(spark: SparkSession, source: Source) -> DataFrame:
        return source.mart(f.__name__, lambda: f(spark, source)) if isinstance(source, Workspace) else f(spark, source)

    return build
