"""Incremental forms of the core marts: daily sales, grain merge, and responses after an anchor."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.staging import TASK_ROWS, shared_dir

LATE = "2 days"


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def daily_sales(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events and amount of each day, type and note; a repeated event within the watermark counts once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "event_type", "k").agg(F.count("*").alias("events"), F.sum("value").alias("amount")).select(F.col("w.start").cast("date").alias("day"), "event_type", "k", "events", "amount")


def responses(events: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Each purchase of a user with the same user's clicks in the time before it: a join of two streams with bounded state."""
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("c_user"), F.col("ts").alias("c_ts"), F.col("event_id").alias("click_id")).withWatermark("c_ts", late)
    paid = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id").withWatermark("ts", late)
    return paid.join(clicks, F.expr(f"user_id = c_user AND c_ts <= ts AND c_ts >= ts - INTERVAL {within}")).select("event_id", "click_id")


def run_available(stream: DataFrame, name: str, mode: str, each: Callable[[DataFrame, int, str], None]) -> str:
    """Runs over what is there and stops; each(batch, epoch, folder) writes. Gives the folder."""
    folder = f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, epoch: each(batch, epoch, folder)).start()
    q.awaitTermination()
    return folder


def append_epoch(batch: DataFrame, epoch: int, folder: str) -> None:
    """A retry of an epoch overwrites what it left."""
    batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of a table of updates, each key's last."""
    rows = spark.read.parquet(f"{folder}/rows/epoch=*")
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_epoch")))).where("_r = 1").drop("_r", "_epoch", "epoch")


#: Rows of a replay's slice, about, where a day has no more.
SLICE = 2_000_000


def slices(days: list[tuple[int | None, date | None, int]], most: int = SLICE) -> list[tuple]:
    """(year, first day, last day) of each slice, from (year, day, rows) in order: whole years, cut between days where they have more rows."""
    out, held = [], 0
    for year, day, n in days:
        if out and out[-1][0] == year and held + n <= most:
            out[-1] = (year, out[-1][1], day)
            held += n
        else:
            out.append((year, day, day))
            held = n
    return out


def replayed(rows: DataFrame, at: str, name: str, last: Callable[[DataFrame], DataFrame] | None = None, most: int = SLICE) -> DataFrame:
    """A stream over rows in order of the day in column at, an epoch for each slice of days; last: from rows some that come after all others.

    rows are computed once and kept in files that are sorted by at, so that a slice reads little else. So an epoch's rows, and what a stream keeps of them, don't grow with
    the table. Each slice is as many files as an epoch takes, some of them empty where it has few rows, so that no epoch mixes slices.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/replay-{name}-{uuid.uuid4().hex}"
    rows.sortWithinPartitions(at).write.parquet(f"{folder}/rows")
    kept, empty, day = spark.read.schema(rows.schema).parquet(f"{folder}/rows"), spark.createDataFrame([], rows.schema).coalesce(1), F.col(at).cast("date")
    counts = [tuple(r) for r in kept.groupBy(F.year(day).alias("y"), day.alias("d")).agg(F.count("*").alias("n")).orderBy("y", "d").collect()]  # a row for each day
    files = max(1, min(spark.sparkContext.defaultParallelism, ceil(min(most, sum(n for _, _, n in counts)) / TASK_ROWS)))
    for i, (_, low, high) in enumerate(slices(counts, most)):
        # Bounds of at itself, not of its day, so that the files' statistics apply.
        within = F.col(at).isNull() if low is None else (F.col(at) >= F.lit(low)) & (F.col(at) < F.lit(high + timedelta(days=1)))
        to = f"{folder}/slices/{i:06d}"
        kept.where(within).coalesce(files).write.parquet(to)
        for _ in range(files - len(spark.read.schema(rows.schema).parquet(to).inputFiles())):
            empty.write.mode("append").parquet(to)
    if not counts:
        empty.write.parquet(f"{folder}/slices/{0:06d}")
    if last is not None:
        last(kept).select(*rows.columns).write.parquet(f"{folder}/slices/last")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/slices/*")
