"""Publishing windows: which weekday and part of the day does best, net of the trend over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posting_windows(df: DataFrame, window: list[str], order: str, value: str, least: int = 3) -> DataFrame:
    """Windows of at least `least` posts: mean of values less their straight line over order, and the lift over all such posts."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    fit = good.agg(F.regr_slope(value, order).alias("_b"), F.regr_intercept(value, order).alias("_a"), F.avg(F.when(F.col(order).isNotNull(), F.col(value))).alias("_m"), F.count(order).alias("_n"))
    rows = good.crossJoin(F.broadcast(fit))  # one row
    level = F.when((F.col("_n") >= 3) & F.col("_b").isNotNull() & F.col(order).isNotNull(), F.col(value) - (F.col("_a") + F.col("_b") * F.col(order)) + F.col("_m")).otherwise(F.col(value))
    s = rows.withColumn("_x", level).groupBy(*window).agg(F.count("*").alias("posts"), F.avg("_x").alias("mean_value"), F.sum("_x").alias("_s")).where(f"posts >= {least}")
    grand = s.agg((F.sum("_s") / F.sum("posts")).alias("_g"))
    return s.crossJoin(F.broadcast(grand)).select(*window, "posts", "mean_value", (F.col("mean_value") - F.col("_g")).alias("perf_lift"))  # one row
