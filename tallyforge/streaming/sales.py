"""Units, amount and distinct orders of each day, shop and SKU from a stream of order lines that may come late.

An epoch adds its rows to the orders of days that are still open, so that lines of an order that come in different epochs count as one order.
Only orders of open days are written; those of days that close with the epoch go into the days' totals at once. The watermark is the latest day seen before the epoch, less ``late`` days. Days before it are closed once: their
totals are appended and their orders dropped, so that what is kept is bounded by the lateness, not by the stream. Rows of closed days,
and rows without a day, go to a table of their own. An epoch's commit comes last; running it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.streaming.partials import commit, is_committed, last_commit

KEYS = ("shop_id", "day", "sku_id")
ORDER = "shop_id long, day date, sku_id long, order_id long, units double, gmv double"


def _by_order(rows: DataFrame) -> DataFrame:
    """Rows are dealt by KEYS alone, so that the days' totals need no further shuffle."""
    sums = rows.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in ORDER.split(", "))).repartition(*KEYS).groupBy(*KEYS, "order_id").agg(F.sum("units").alias("units"), F.sum("gmv").alias("gmv"))
    return sums.select(*(f.split()[0] for f in ORDER.split(", ")))


def _by_day(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*KEYS).agg(F.sum("units").alias("units"), F.sum("gmv").alias("gmv"), F.count("*").alias("order_count"))


def sales_epoch(late: int) -> Callable[[DataFrame, int, str], None]:
    """For foreachBatch over (shop_id, day, sku_id, order_id, units, gmv)."""

    def each(batch: DataFrame, epoch: int, folder: str) -> None:
        spark = batch.sparkSession
        if is_committed(spark, folder, epoch):
            return
        known = last_commit(spark, folder, epoch)
        told = known.told if known else {}
        closed = date.fromisoformat(told["closed"]) if told.get("closed") else None
        fits = F.col("day").isNotNull() if closed is None else F.coalesce(F.col("day") >= F.lit(closed), F.lit(False))
        batch.where(~fits).write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        latest = batch.agg(F.max("day")).first()[0]
        rows = batch.where(fits).select(*(f.split()[0] for f in ORDER.split(", ")))
        if latest is not None:
            reached = latest - timedelta(days=late)
            closed = max(closed, reached) if closed else reached
        if known and told["open"] == "yes":
            rows = rows.unionByName(spark.read.schema(ORDER).parquet(f"{folder}/orders/{known.epoch}/closed=false"))
        ends = F.lit(False) if closed is None else F.col("day") < F.lit(closed)
        _by_day(_by_order(rows.where(ends))).write.mode("overwrite").parquet(f"{folder}/days/epoch={epoch}")
        path = f"{folder}/orders/{epoch}/closed=false"
        _by_order(rows.where(~ends)).write.mode("overwrite").parquet(path)
        still = "no" if spark.read.schema(ORDER).parquet(path).isEmpty() else "yes"
        commit(spark, folder, epoch, [], {"closed": closed.isoformat() if closed else "", "open": still})

    return each


def sku_days(spark: SparkSession, folder: str) -> DataFrame:
    """Totals by day, shop and SKU of all committed epochs; final: the day is closed."""
    last = last_commit(spark, folder)
    days = spark.read.parquet(f"{folder}/days/epoch=*").where(F.col("_metadata.file_path").rlike("/days/")).select(*KEYS, "units", "gmv", "order_count", F.lit(True).alias("final"))
    if last.told["open"] == "no":
        return days
    rest = _by_day(spark.read.schema(ORDER).parquet(f"{folder}/orders/{last.epoch}/closed=false"))
    return days.unionByName(rest.withColumn("final", F.lit(False)))


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/late/epoch=*")
