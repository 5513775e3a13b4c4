"""Covered periods of sources: which days each source has, lacks and shares with others.

A source's period adds one on its first day and takes one off on the day after its last; the running sum of these
says how many cover a day. Steps are summed by day first, so that a source's sweep has at most a row for each day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def steps(periods: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, day, step) of periods (keys, first_day, last_day), ends included; a period without an end or that ends before it begins is none."""
    good = periods.where("first_day <= last_day")
    both = F.array(F.struct(F.col("first_day").alias("day"), F.lit(1).alias("step")), F.struct(F.date_add("last_day", 1).alias("day"), F.lit(-1).alias("step")))
    return good.select(*keys, F.inline(both)).groupBy(*keys, "day").agg(F.sum("step").alias("step"))


def covered(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint (keys, first_day, last_day, days) that periods cover; those that overlap or touch are one."""
    by = W.partitionBy(*keys).orderBy("day") if keys else W.partitionBy(F.lit(0)).orderBy("day")
    swept = steps(periods, keys).withColumn("depth", F.sum("step").over(by)).withColumn("_before", F.col("depth") - F.col("step"))
    edges = swept.where("(depth = 0) <> (_before = 0)").withColumn("_next", F.lead("day").over(by))
    out = edges.where("depth > 0").select(*keys, F.col("day").alias("first_day"), F.date_sub("_next", 1).alias("last_day"))
    return out.withColumn("days", F.datediff("last_day", "first_day") + 1)


def missing(periods: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps between a key's covered periods."""
    by = W.partitionBy(*keys).orderBy("first_day") if keys else W.partitionBy(F.lit(0)).orderBy("first_day")
    rows = covered(periods, keys).withColumn("_next", F.lead("first_day").over(by)).where("_next IS NOT NULL")
    out = rows.select(*keys, F.date_add("last_day", 1).alias("first_day"), F.date_sub("_next", 1).alias("last_day"))
    return out.withColumn("days", F.datediff("last_day", "first_day") + 1)


def shared(periods: DataFrame, source: str, priority: dict[str, int]) -> DataFrame:
    """Periods in which the same sources have data: (first_day, last_day, days, sources, primary: the one of least priority).

    priority: the sources that count; few, as each is a column of the sweep.
    """
    swept = steps(covered(periods, [source]), [source])
    depth = {s: F.sum(F.when(F.col(source) == s, F.col("step")).otherwise(0)) for s in priority}
    days = swept.where(F.col(source).isin(*priority)).groupBy("day").agg(*(d.alias(f"_{i}") for i, d in enumerate(depth.values())))
    by = W.partitionBy(F.lit(0)).orderBy("day")  # a row for each day on which a period begins or ends
    have = [F.when(F.sum(f"_{i}").over(by) > 0, F.struct(F.lit(p).alias("p"), F.lit(s).alias("s"))) for i, (s, p) in enumerate(priority.items())]
    rows = days.select("day", F.array_sort(F.array_compact(F.array(*have))).alias("x"), F.lead("day").over(by).alias("_next")).where("_next IS NOT NULL AND size(x) > 0")
    names = F.array_sort(F.transform("x", lambda x: x["s"]))
    out = rows.select(F.col("day").alias("first_day"), F.date_sub("_next", 1).alias("last_day"), F.concat_ws(",", names).alias("sources"), F.col("x")[0]["s"].alias("primary"))
    return out.withColumn("days", F.datediff("last_day", "first_day") + 1)
