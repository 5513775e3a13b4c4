"""Anchored windows: what was sold before and after each anchor.

The join is on the shop and SKU with the days as its further condition, so Spark picks a hash or sort-merge
join; all windows are conditional sums of one pass. Anchors without sales stay, with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Window name, days before (from, to) and after (from, to), ends exclusive.
LIFT_WINDOWS = (("d0_1", (-1, 0), (0, 1)), ("d1_3", (-3, 0), (1, 4)), ("d4_7", (-4, 0), (4, 8)), ("d8_14", (-7, 0), (8, 15)))
RESPONSE = (("d0_1_units", 0, 1), ("d1_3_units", 1, 4), ("d4_7_units", 4, 8), ("d8_14_units", 8, 15))


def _near(anchors: DataFrame, sales: DataFrame, lo: int, hi: int) -> DataFrame:
    s = sales.select(F.col("shop_id").alias("_shop"), F.col("sku_id").alias("_sku"), F.col("day").alias("_day"), "units")
    gap = F.datediff("_day", "publish_day")
    return anchors.join(s, (F.col("shop_id") == F.col("_shop")) & (F.col("sku_id") == F.col("_sku")) & (gap >= lo) & (gap < hi), "left").withColumn("_gap", gap)


def anchored_lift(anchors: DataFrame, sales: DataFrame, windows: tuple = LIFT_WINDOWS) -> DataFrame:
    """A row for each anchor and window: units before and after, days matched, absolute and relative lift."""
    g = F.col("_gap")
    inside = lambda r: (g >= r[0]) & (g < r[1])
    units = lambda r: F.coalesce(F.sum(F.when(inside(r), F.col("units"))), F.lit(0.0))
    sums = [F.struct(F.lit(name).alias("window"), units(pre).alias("pre_units"), units(post).alias("post_units"), F.count_if(inside(pre) | inside(post)).alias("matched_sales_days")) for name, pre, post in windows]
    lo, hi = min(w[1][0] for w in windows), max(w[2][1] for w in windows)
    wide = _near(anchors, sales, lo, hi).groupBy("shop_id", "note_id", "sku_id", "publish_day").agg(F.array(*sums).alias("w"))
    out = wide.select("shop_id", "note_id", "sku_id", "publish_day", F.inline("w"))
    lift = F.when(F.col("matched_sales_days") > 0, F.col("post_units") - F.col("pre_units"))
    return out.withColumns({"absolute_lift": lift, "relative_lift": F.when(F.col("pre_units") > 0, lift / F.nullif(F.col("pre_units"), F.lit(0.0)))})


def response_windows(anchors: DataFrame, sales: DataFrame) -> DataFrame:
    """One row for each anchor: units in four windows after it."""
    g = F.col("_gap")
    units = [F.coalesce(F.sum(F.when((g >= lo) & (g < hi), F.col("units"))), F.lit(0.0)).alias(name) for name, lo, hi in RESPONSE]
    return _near(anchors, sales, RESPONSE[0][1], RESPONSE[-1][2]).groupBy("shop_id", "note_id", "sku_id", "publish_day").agg(*units, F.count("_day").alias("matched_sales_days"))


def event_lift(daily: DataFrame, events: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means on event days against the other days, one row for each metric."""
    marked = daily.join(events.select(F.col("day").alias("_e")).distinct(), F.col("day") == F.col("_e"), "left").withColumn("is_event", F.col("_e").isNotNull())
    rows = [F.struct(F.lit(m).alias("metric"), F.avg(F.when(F.col("is_event"), F.col(m))).alias("event_value"), F.avg(F.when(~F.col("is_event"), F.col(m))).alias("baseline_value")) for m in metrics]
    out = marked.groupBy(*keys).agg(F.array(*rows).alias("r")).select(*keys, F.inline("r"))
    return out.withColumn("lift_pct", F.when(F.col("baseline_value") != 0, (F.col("event_value") - F.col("baseline_value")) / F.nullif(F.col("baseline_value"), F.lit(0.0))))
