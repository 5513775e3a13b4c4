"""Growth bridges: a change of GMV split into traffic, conversion and order value by logarithmic means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FACTORS = ("traffic", "conversion", "aov")
EPS = 1e-9


def log_mean(a: Column, b: Column) -> Column:
    return F.when(F.abs(a - b) < EPS, a).otherwise((b - a) / (F.ln(b) - F.ln(a)))


def gmv_bridge(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    """For rows (keys, period, visitors, buyers, gmv): each period against the one before.

    buyers must be the period's distinct people, not a sum of daily ones. A factor of zero or less leaves the split
    undefined: partial, with the whole change as residual.
    """
    by = W.partitionBy(*keys).orderBy(period) if keys else W.partitionBy(F.lit(0)).orderBy(period)
    v, b, g = (F.col(c).cast("double") for c in ("visitors", "buyers", "gmv"))
    rates = df.withColumns({"_v": v, "_c": F.when(v > 0, b / v).otherwise(0.0), "_a": F.when(b > 0, g / b).otherwise(0.0)})
    both = rates.withColumns({f"{c}0": F.lag(c).over(by) for c in ("_v", "_c", "_a")}).where("_v0 IS NOT NULL")
    pairs = {"traffic": ("_v0", "_v"), "conversion": ("_c0", "_c"), "aov": ("_a0", "_a")}
    good = F.lit(True)
    for a, z in pairs.values():
        good = good & (F.col(a) > 0) & (F.col(z) > 0)
    g0, g1 = F.col("_v0") * F.col("_c0") * F.col("_a0"), F.col("_v") * F.col("_c") * F.col("_a")
    weight = F.when(good, log_mean(g0, g1))
    out = both.withColumns({"delta_gmv": g1 - g0, "partial": ~good, **{f"contrib_{n}": F.when(good, weight * F.ln(F.col(z) / F.col(a))).otherwise(0.0) for n, (a, z) in pairs.items()}})
    total = sum((F.col(f"contrib_{n}") for n in FACTORS), F.lit(0.0))
    size = F.array(*(F.struct(F.abs(f"contrib_{n}").alias("x"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(FACTORS)))
    dominant = F.when(~F.col("partial") & (F.abs("delta_gmv") >= EPS), F.array_max(size)["n"])
    return out.select(*keys, period, "delta_gmv", *(f"contrib_{n}" for n in FACTORS), (F.col("delta_gmv") - total).alias("residual"), dominant.alias("dominant_factor"), "partial")


def bridge_shares(bridge: DataFrame, keys: list[str], period: str) -> DataFrame:
    """A row for each factor: its contribution, share of all movement, and whether factors offset each other."""
    rows = bridge.where("NOT partial").select(*keys, period, "dominant_factor", F.inline(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(f"contrib_{n}").alias("contribution")) for n in FACTORS))))
    by = W.partitionBy(*keys, period)
    moved = F.sum(F.abs("contribution")).over(by)
    offset = (F.max("contribution").over(by) > 0) & (F.min("contribution").over(by) < 0)
    return rows.select(*keys, period, "factor", "contribution", F.when(moved > 0, F.abs("contribution") / moved).alias("movement_share"), F.coalesce(F.col("factor") == F.col("dominant_factor"), F.lit(False)).alias("is_dominant"), offset.alias("offsetting"))


def ledger(bridge: DataFrame, refunds: DataFrame, keys: list[str]) -> DataFrame:
    """Recoverable amounts by lever; they overlap, so there is no total: lost conversion, lost order value, refunds."""
    lost = bridge.groupBy(*keys).agg(*(F.sum(F.when(F.col(f"contrib_{n}") < 0, -F.col(f"contrib_{n}")).otherwise(0.0)).alias(n) for n in ("conversion", "aov")))
    pool = refunds.groupBy(*keys).agg(F.sum("refund_amount").alias("refunds"))
    levers = F.array(*(F.struct(F.lit(name).alias("lever"), F.col(c).alias("amount")) for name, c in (("conversion_ceiling", "conversion"), ("order_value_ceiling", "aov"), ("refund_pool", "refunds"))))
    return lost.join(pool, keys).select(*keys, F.inline(levers))


def gate(df: DataFrame) -> DataFrame:
    """Whether sums of daily people may stand for a period's people: refused where they count someone twice (buyer_days against buyers)."""
    return df.withColumn("daily_sums", F.when(F.col("buyer_days") > F.col("buyers"), "refused").otherwise("allowed"))
