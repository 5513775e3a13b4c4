"""Several tables that are published together: a reader sees all of one run or all of another.

A run's tables are written below its own folder; a pointer is written last, and readers follow the newest one. A run that stops half-way
is never read, and one that is published again under its name is left as it is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, FORMATS = "number long, run string, tables map<string, string>", ("parquet", "json")


def _pointers(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(POINTER).parquet(f"{folder}/pointers/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise


def current(spark: SparkSession, folder: str) -> dict | None:
    """(number, run, tables: format by name) of the newest run."""
    found = _pointers(spark, folder)
    row = found.orderBy(F.desc("number")).first() if found is not None else None
    return row.asDict() if row else None


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, run: str, formats: tuple[str, ...] = FORMATS) -> None:
    """Writes each table in each format under the run, then the pointer. One run is published at a time. A table is computed once: further formats are written from the first one's files."""
    before = current(spark, folder)
    known = _pointers(spark, folder)
    if known is not None and not known.where(F.col("run") == run).isEmpty():
        return
    for name, df in tables.items():
        rows = df
        for kind in formats:
            path = f"{folder}/runs/{run}/{name}.{kind}"
            rows.write.mode("overwrite").format(kind).save(path)
            rows = rows if kind != formats[0] else spark.read.schema(df.schema).format(kind).load(path)
    number = before["number"] + 1 if before else 0
    pointer = spark.createDataFrame([(number, run, {name: formats[0] for name in tables})], POINTER)
    pointer.coalesce(1).write.parquet(f"{folder}/pointers/{number}")


def published(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the newest run."""
    found = current(spark, folder)
    if found is None or table not in found["tables"]:
        raise LookupError(f"{table} isn't published below {folder}")
    kind = found["tables"][table]
    return spark.read.format(kind).load(f"{folder}/runs/{found['run']}/{table}.{kind}")
