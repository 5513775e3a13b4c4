"""What sells after an anchor, on live streams, in two forms.

``response_windows`` is an outer join of two streams, then sums by anchor, for streams of few rows: all its rows go through state stores.
``responses_epoch`` is for foreachBatch over one stream of both, for streams of many: an epoch's rows and those that are still open are joined as tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.staging import TASK_ROWS, spread
from tallyforge.streaming.partials import commit, last_commit

# Days after the anchor that each window begins with and ends before.
WINDOWS = {"d0_1": (0, 1), "d1_3": (1, 4), "d4_7": (4, 8), "d8_14": (8, 15)}
LAST = max(end for _, end in WINDOWS.values())


def response_windows(anchors: DataFrame, sales: DataFrame, keys: list[str], late: str, salts: int = 1) -> DataFrame:
    """Units in each window after each anchor, and days with sales, for append mode.

    anchors: (keys, note_id, publish_ts); sales: (keys, sale_ts, units), both streams. A row for an anchor is sent once, when the
    watermark has passed the end of its last window; anchors without sales have zeros. The watermarks bound the state: an anchor is kept for LAST days and the
    lateness, a sale for the lateness. salts: parts that a key's anchors are dealt to; its sales go to each of them, so that a SKU
    with a third of all rows isn't one task's.
    """
    salt = F.pmod(F.xxhash64("note_id"), F.lit(salts)).cast("int")
    a = anchors.withWatermark("publish_ts", late).withColumn("_salt", salt)
    b = sales.withWatermark("sale_ts", late).select(*(F.col(k).alias(f"_s_{k}") for k in keys), "sale_ts", "units", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s_salt"))
    same = [F.col(k) == F.col(f"_s_{k}") for k in keys] + [F.col("_salt") == F.col("_s_salt")]
    within = [F.col("sale_ts") >= F.col("publish_ts"), F.col("sale_ts") < F.col("publish_ts") + F.expr(f"INTERVAL {LAST} DAYS")]
    joined = a.join(b, [*same, *within], "left_outer")
    gap = F.datediff("sale_ts", "publish_ts")

    def units(low: int, high: int) -> Column:
        return F.coalesce(F.sum(F.when((gap >= low) & (gap < high), F.col("units"))), F.lit(0.0))

    sums = (units(low, high).alias(f"{name}_units") for name, (low, high) in WINDOWS.items())
    return joined.groupBy(*keys, "note_id", "publish_ts").agg(*sums, F.size(F.collect_set(gap)).cast("long").alias("matched_sales_days"))


def by_day(anchors: DataFrame, sales: DataFrame, keys: list[str], rows: int = 0) -> DataFrame:
    """Units in each window after each anchor, and days with sales; rows: how many there are, about.

    anchors: (keys, note_id, day), where one that comes twice counts its sales twice; sales: (keys, day, units). The days of a key that have sales are joined to those that have anchors, and
    the anchors to their sums by key and day, so that a SKU with a third of all rows neither fans out nor is one task's.
    """
    sold = spread(sales.groupBy(*keys, "day").agg(F.sum("units").alias("units")), rows, *keys).select(*(F.col(k).alias(f"_s_{k}") for k in keys), F.col("day").alias("_s_day"), "units")
    gap = F.datediff("_s_day", "day")
    near = [F.col(k) == F.col(f"_s_{k}") for k in keys] + [gap >= 0, gap < LAST]
    sums = {f"{name}_units": F.sum(F.when((gap >= low) & (gap < high), F.col("units"))) for name, (low, high) in WINDOWS.items()}
    marks = spread(anchors.select(*keys, "day").distinct(), rows, *keys).hint("shuffle_hash")
    found = sold.join(marks, near).groupBy(*keys, "day").agg(*(v.alias(c) for c, v in sums.items()), F.count("*").alias("matched_sales_days"))
    once = anchors.repartition(max(1, ceil(rows / TASK_ROWS)), *keys, "day").groupBy(*keys, "note_id", "day").agg(F.count("*").alias("_times"))
    units = (F.coalesce(F.col(c) * F.col("_times"), F.lit(0.0)).alias(c) for c in sums)
    return once.join(found.hint("shuffle_hash"), [*keys, "day"], "left").select(*keys, "note_id", "day", *units, F.coalesce("matched_sales_days", F.lit(0)).cast("long").alias("matched_sales_days"))


def responses_epoch(keys: list[str], late: int) -> Callable[[DataFrame, int, str], None]:
    """For foreachBatch over (keys, note_id: null where a row is no anchor, day, units, sold: whether it is a sale); see by_day.

    The watermark is the latest day seen before the epoch, less late days; rows of earlier days, and rows without a day, go to a table of their own. An anchor is sent once, in
    the epoch after which no sale of its windows can come. Rows are kept for LAST days and the lateness. An epoch's commit comes last; running it again changes nothing.
    """

    def each(batch: DataFrame, epoch: int, folder: str) -> None:
        spark = batch.sparkSession
        known = last_commit(spark, folder, epoch + 1)
        if known and known.epoch == epoch:
            return
        closed = date.fromisoformat(known.told["closed"]) if known and known.told["closed"] else None
        fits = F.col("day").isNotNull() if closed is None else F.coalesce(F.col("day") >= F.lit(closed), F.lit(False))
        batch = batch.withColumn("_fits", fits)
        rows = batch
        if known:
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/open/{known.epoch}"))
        latest, n, missed = rows.agg(F.max("day"), F.count("*"), F.count_if(~F.col("_fits"))).first()
        rows = rows.where("_fits")
        if latest is not None:
            reached = latest - timedelta(days=late)
            closed = max(closed, reached) if closed else reached
        ended = F.lit(False) if closed is None else F.col("day") <= F.lit(closed - timedelta(days=LAST))
        by_day(rows.where(ended & F.col("note_id").isNotNull()), rows.where("sold"), keys, n).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")
        rows.where(~ended).coalesce(max(1, ceil(n / TASK_ROWS))).write.mode("overwrite").parquet(f"{folder}/open/{epoch}")
        if missed:
            batch.where("NOT _fits").drop("_fits").write.mode("overwrite").parquet(f"{folder}/late/epoch={epoch}")
        commit(spark, folder, epoch, [], {"closed": closed.isoformat() if closed else ""})

    return each


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """What all committed epochs have sent."""
    last = last_commit(spark, folder)
    if last is None:
        raise LookupError(f"no epoch was committed below {folder}")
    return spark.read.parquet(f"{folder}/rows").where(F.col("epoch") <= last.epoch).drop("epoch")
