"""A table of mergeable partial aggregates, fed by epochs of a stream.

An epoch writes the partial aggregate of its own rows as a part, and a commit that lists the table's parts. Where the last parts are
no larger than twice the new one, they are merged into one, so that what is written follows the epochs' rows (each row is
written again a logarithmic number of times) and there are few parts to read. The commit comes last: an epoch that was
stopped leaves nothing that is read, one that is run again with its commit there changes nothing. Merging must be associative and must not depend on order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

COMMIT = "epoch long, parts array<struct<path: string, rows: long>>, told map<string, string>"
Merge = Callable[[DataFrame], DataFrame]


def last_commit(spark: SparkSession, folder: str, before: int | None = None) -> Row | None:
    """The newest commit, or the newest before an epoch."""
    try:
        rows = spark.read.schema(COMMIT).parquet(f"{folder}/commits/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise
    if before is not None:
        rows = rows.where(F.col("epoch") < before)
    return rows.orderBy(F.desc("epoch")).first()


def commit(spark: SparkSession, folder: str, epoch: int, parts: list[tuple[str, int]], told: dict[str, str] | None = None) -> None:
    spark.createDataFrame([(epoch, parts, told or {})], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/{epoch}")


def is_committed(spark: SparkSession, folder: str, epoch: int) -> bool:
    found = last_commit(spark, folder, epoch + 1)
    return found is not None and found.epoch == epoch


def read_parts(spark: SparkSession, parts: list[tuple[str, int]], merge: Merge) -> DataFrame:
    return merge(reduce(DataFrame.unionByName, (spark.read.parquet(p) for p, _ in parts)))


def append(rows: DataFrame, epoch: int, folder: str, merge: Merge) -> None:
    """rows: the partial aggregate of an epoch."""
    spark = rows.sparkSession
    if is_committed(spark, folder, epoch):
        return
    known = last_commit(spark, folder, epoch)
    parts = [(p.path, p.rows) for p in known.parts] if known else []
    path, level = f"{folder}/parts/{epoch}-0", 0
    rows.write.mode("overwrite").parquet(path)
    size = spark.read.parquet(path).count()
    while parts and parts[-1][1] <= 2 * size:
        level += 1
        merged = read_parts(spark, [parts.pop(), (path, size)], merge)
        path = f"{folder}/parts/{epoch}-{level}"
        merged.write.mode("overwrite").parquet(path)
        size = spark.read.parquet(path).count()
    commit(spark, folder, epoch, [*parts, (path, size)])


def read(spark: SparkSession, folder: str, merge: Merge) -> DataFrame:
    """The whole table as of its last commit."""
    found = last_commit(spark, folder)
    if found is None:
        raise LookupError(f"no epoch was committed below {folder}")
    return read_parts(spark, [(p.path, p.rows) for p in found.parts], merge)


# First values by key


def first_values(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of each key and column the value that comes first in order and isn't null, with its order, and the least and most value."""
    parts = [F.min(order).alias(order)]
    for c in values:
        parts.append(F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("value")))).alias(c))
        parts += [F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_most")]
    return rows.groupBy(*keys).agg(*parts)


def merge_first(keys: list[str], order: str, values: list[str]) -> Merge:
    def merge(rows: DataFrame) -> DataFrame:
        parts = [F.min(order).alias(order)]
        for c in values:
            parts += [F.min(c).alias(c), F.min(f"{c}_least").alias(f"{c}_least"), F.max(f"{c}_most").alias(f"{c}_most")]
        return rows.groupBy(*keys).agg(*parts)

    return merge


def merge_epoch(keys: list[str], order: str) -> Callable[[DataFrame, int, str], None]:
    """For foreachBatch: the grain merge of a stream, equal to that of all its rows whatever the order of its files."""

    def each(batch: DataFrame, epoch: int, folder: str) -> None:
        values = [c for c in batch.columns if c not in (*keys, order)]
        append(first_values(batch, keys, order, values), epoch, folder, merge_first(keys, order, values))

    return each


def merged(spark: SparkSession, folder: str, keys: list[str], order: str, values: list[str]) -> DataFrame:
    rows = read(spark, folder, merge_first(keys, order, values))
    return rows.select(*keys, order, *(F.col(f"{c}.value").alias(c) for c in values))


def conflicts(spark: SparkSession, folder: str, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """(keys, conflict: the column) where rows of a key differ."""
    rows = read(spark, folder, merge_first(keys, order, values))
    differs = F.array(*(F.when(F.col(f"{c}_least") != F.col(f"{c}_most"), F.lit(c)) for c in values))
    return rows.select(*keys, F.explode(F.array_compact(differs)).alias("conflict"))
