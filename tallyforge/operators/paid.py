"""Paid traffic: efficiency, hierarchy, budget action, spend response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import ratio
from tallyforge.operators.distribution import banded
from tallyforge.operators.ranks import top_rows

# Least spend, high and low ROAS, least clicks, least active days of a budget decision; items of a level shown.
SPEND, HIGH, LOW, CLICKS, DAYS, SHOWN = 100.0, 3.0, 1.0, 20, 2, 20


def efficiency(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of rows (day, spend, impressions, clicks, orders, gmv) and their ratios; reported rates are means weighted by their base."""
    s = df.groupBy(*keys).agg(F.countDistinct("day").alias("paid_active_days"), *(F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "orders", "gmv")))
    return with_ratios(s)


def with_ratios(s: DataFrame) -> DataFrame:
    c = F.col
    return s.withColumns({
        "ctr_calc": ratio(c("clicks"), c("impressions")), "cpm_calc": ratio(c("spend"), c("impressions")) * 1000, "cpc_calc": ratio(c("spend"), c("clicks")), "order_rate_calc": ratio(c("orders"), c("clicks")),
        "cpo_calc": ratio(c("spend"), c("orders")), "roas_calc": ratio(c("gmv"), c("spend")),
    })


def weighted_average(value: Column, weight: Column) -> Column:
    """Weighted where weights are known and positive, else the plain mean."""
    both = value.isNotNull() & (weight > 0)
    total = F.sum(F.when(both, weight))
    return F.coalesce(F.sum(F.when(both, value * weight)) / F.nullif(total, F.lit(0.0)), F.avg(value))


def roas_sources(df: DataFrame, keys: list[str]) -> DataFrame:
    """ROAS of rows (spend, gmv, roas, roi) by key, calculated and as reported, which of them counts, where it comes from and how far they are apart."""
    reported = F.coalesce("roas", "roi")
    s = df.groupBy(*keys).agg(F.sum("spend").alias("spend"), F.sum("gmv").alias("gmv"), F.count("roas").alias("_roas"), F.count("roi").alias("_roi"), weighted_average(reported, F.col("spend")).alias("roas_reported"))
    s = s.withColumn("roas_calc", ratio(F.col("gmv"), F.col("spend")))
    source = F.when(F.col("roas_calc").isNotNull(), "calculated_gmv").when((F.col("_roas") > 0) & (F.col("_roi") > 0), "reported_mixed_roas_roi").when(F.col("_roas") > 0, "reported_roas").when(F.col("_roi") > 0, "reported_roi")
    return s.select(*keys, "spend", "gmv", "roas_calc", "roas_reported", F.coalesce("roas_calc", "roas_reported").alias("roas_effective"), source.alias("roas_source"), (F.col("roas_calc") - F.col("roas_reported")).alias("roas_gap"))


def hierarchy(df: DataFrame, levels: list[str], shown: int = SHOWN) -> DataFrame:
    """The same sums for each level by itself in one pass (grouping sets), the `shown` largest spenders of each."""
    sets = df.groupingSets([[level] for level in levels], *levels).agg(F.grouping_id(*levels).alias("_g"), *(F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "orders", "gmv")))
    top = 2 ** len(levels) - 1
    name, item = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, level in enumerate(levels):
        this = F.col("_g") == top - 2 ** (len(levels) - 1 - i)
        name, item = F.when(this, level).otherwise(name), F.when(this, F.col(level).cast("string")).otherwise(item)
    rows = sets.select(name.alias("level"), item.alias("object_id"), "spend", "impressions", "clicks", "orders", "gmv").where("object_id IS NOT NULL")
    return with_ratios(top_rows(rows, ["level"], [F.desc("spend"), F.asc("object_id")], shown).drop("_rank"))


def budget_action(spend: Column, clicks: Column, gmv: Column, roas: Column, days: Column) -> Column:
    """needs_data, hold, increase or reduce; the order of the tests counts."""
    few = (clicks < CLICKS) | (days < DAYS)
    return F.when(spend.isNull() | gmv.isNull() | roas.isNull(), "needs_data").when(few, "hold").when((spend >= SPEND) & (roas >= HIGH), "increase").when((spend >= SPEND) & (roas < LOW), "reduce").otherwise("hold")


def spend_response(df: DataFrame, bins: int = 4) -> DataFrame:
    """Quantile bins of (spend, gmv): averages, pooled ROAS, and the marginal ROAS against the bin before that has rows."""
    good = df.where("spend > 0 AND gmv IS NOT NULL AND NOT isnan(gmv)")
    s = banded(good, [], "spend", bins).groupBy(F.col("band").alias("bin")).agg(F.count("*").alias("n"), F.avg("spend").alias("avg_spend"), F.avg("gmv").alias("avg_gmv"), (F.sum("gmv") / F.sum("spend")).alias("avg_roas"))
    by = W.partitionBy(F.lit(0)).orderBy("bin")  # one row for each bin
    step = F.col("avg_spend") - F.lag("avg_spend").over(by)
    out = s.withColumn("marginal_roas", F.when(step > 0, (F.col("avg_gmv") - F.lag("avg_gmv").over(by)) / F.nullif(step, F.lit(0.0))))
    first = F.min(F.when(F.col("marginal_roas") < 1, F.col("bin"))).over(W.partitionBy(F.lit(0)))
    return out.withColumn("is_saturation", F.coalesce(F.col("bin") == first, F.lit(False)))


def capabilities(df: DataFrame, keys: list[str], metrics: dict[str, str], links: dict[str, str], coarsest: str) -> DataFrame:
    """What exports of a key can answer: which metrics have any amount, rows with each link (finest first), and the finest grain that has one."""
    flags = [(F.coalesce(F.sum(c), F.lit(0)) > 0).alias(f"has_{n}_metrics") for n, c in metrics.items()]
    grain = F.lit(coarsest)
    for name, c in reversed(links.items()):
        grain = F.when(F.count(c) > 0, name).otherwise(grain)
    linked = [F.count(c).alias(f"{n}_link_rows") for n, c in links.items()]
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.sum("spend").alias("total_spend"), *flags, *linked, grain.alias("detected_grain")
    )


def reported_gap(df: DataFrame, keys: list[str]) -> DataFrame:
    """Price per thousand impressions from sums and as reported (cpm, weighted by its impressions), which of them counts, and how far they are apart."""
    sums = (F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "orders", "gmv"))
    s = df.groupBy(*keys).agg(*sums, weighted_average(F.col("cpm"), F.col("impressions")).alias("cpm_reported"))
    calc = ratio(F.col("spend") * 1000, F.col("impressions"))
    return s.withColumns({
        "ctr_calc": ratio(F.col("clicks"), F.col("impressions")), "cpm_calc": calc, "cpm_effective": F.coalesce(calc, F.col("cpm_reported")), "cpm_gap": calc - F.col("cpm_reported"),
    })
