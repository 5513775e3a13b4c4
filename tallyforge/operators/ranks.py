"""Row numbers and running sums without one task that sees all rows of a table or of a group.

Rows are range-partitioned by group and order and stored so, as both uses of them need the same ranges. The counts and sums of a group's
earlier partitions become offsets for its later ones; the rest is local to partitions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.staging import stored


def with_group(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of totals, which has one row for each group of keys; null keys are a group, and keys=[] is one."""
    if not keys:
        return df.crossJoin(F.broadcast(totals))  # one row
    named = totals.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    return df.join(named, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys))).drop(*(f"_g_{k}" for k in keys))


def ranked(df: DataFrame, keys: list[str], order: list[Column], value: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with ``_rank`` from 1 in the given total order within keys, ``_size`` of the group and, for a value column, ``_running`` and ``_total`` sums."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id()), "ranked")
    amount = F.col(value).cast("double") if value else F.lit(0.0)
    here = W.partitionBy("_part", *keys)
    local = here.orderBy(*order)
    rows = ranged.withColumns({"_r": F.row_number().over(local), "_s": F.sum(amount).over(local.rowsBetween(W.unboundedPreceding, 0)), "_n": F.count("*").over(here), "_v": F.sum(amount).over(here)})
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # a row for each partition that a group lies in
    before = by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.sum(amount).alias("_v"))
    offsets = sizes.withColumns({"_parts": F.count("*").over(by), "_n0": F.sum("_n").over(before), "_v0": F.sum("_v").over(before), "_n1": F.sum("_n").over(by), "_v1": F.sum("_v").over(by)})
    # Ranges put at most one group across each of their ends, so that these are at most twice as many rows as partitions.
    spread = offsets.where("_parts > 1").select(F.col("_part").alias("_g_part"), *(F.col(k).alias(f"_g_{k}") for k in keys), "_n0", "_v0", "_n1", "_v1")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys), F.col("_part") == F.col("_g_part"))
    out = rows.join(F.broadcast(spread), same, "left").withColumns({"_rank": F.col("_r") + F.coalesce("_n0", F.lit(0)), "_size": F.coalesce("_n1", "_n")})
    if value:
        out = out.withColumns({"_running": F.col("_s") + F.coalesce("_v0", F.lit(0.0)), "_total": F.coalesce("_v1", "_v")})
    return out.drop("_part", "_r", "_s", "_n", "_v", "_n0", "_v0", "_n1", "_v1", "_g_part", *(f"_g_{k}" for k in keys))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, parts: int = 64) -> DataFrame:
    """The first n rows of each group with ``_rank`` from 1: of each of its parts first, so that a group's task sees n rows of each part."""
    part = df.withColumn("_part", F.pmod(F.xxhash64(*(F.col(c) for c, t in df.dtypes if not t.startswith("map"))), F.lit(parts)))
    first = F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order))
    few = part.withColumn("_rank", first).where(F.col("_rank") <= n).drop("_part")
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return few.withColumn("_rank", F.row_number().over(by.orderBy(*order))).where(F.col("_rank") <= n)


def global_rank(df: DataFrame, order: list[Column], value: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with ``rank`` from 1 in the given total order and, for a value column, its ``running`` sum and ``total``."""
    return ranked(df, [], order, value, partitions).drop("_size").withColumnsRenamed({"_rank": "rank", "_running": "running", "_total": "total"})


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _c: rows with that value, _before: rows of the group below it, _of: rows of the group) for values that aren't null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    out = ranked(counts, keys, [F.asc(value)], "_c")
    return out.select(*keys, value, "_c", (F.col("_running") - F.col("_c")).cast("long").alias("_before"), F.col("_total").cast("long").alias("_of"))
