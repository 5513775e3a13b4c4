"""Grouped distribution and concentration operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.ranks import counted, ranked, with_group


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Size, mean, quartiles, range and variation of each group; quartiles by ranges of values, as quantile_edges has them."""
    v = F.col(value)
    quarters = quantiles(df, keys, value, (0.25, 0.5, 0.75)).withColumnRenamed("quantiles", "_q")
    stats = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("_s"))
    stats = with_group(stats, quarters, keys)
    return stats.select(*keys, "n", "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("p25"), F.col("_q")[2].alias("p75"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "min", "max", F.when(F.col("mean") != 0, F.col("_s") / F.col("mean")).alias("cv"))


def quantile_edges(df: DataFrame, keys: list[str], value: str, n: int = 4) -> DataFrame:
    """(keys, edges): the least value and the inner quantiles, n left edges; groups of under n values have none.

    Places between two values are interpolated. Values are counted and ranked by ranges, so that no task keeps all of a group's.
    """
    edges = quantiles(df, keys, value, tuple(i / n for i in range(n)), n)
    return edges.withColumnRenamed("quantiles", "edges")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], least: int = 1) -> DataFrame:
    """(keys, quantiles: an array in the order of shares) of groups with so many values at least."""
    share = F.array(*map(F.lit, shares))
    at = lambda i: (F.col("_of") - 1) * F.element_at(share, i + 1)
    has = lambda place: (place >= F.col("_before")) & (place < F.col("_before") + F.col("_c"))
    values = counted(df, keys, value).where(f"_of >= {least}")
    met = values.withColumn("_i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: has(F.floor(at(i))) | has(F.ceil(at(i))))))
    place, v = at(F.col("_i")), F.col(value).cast("double")
    ends = met.withColumn("_share", place - F.floor(place)).groupBy(*keys, "_i").agg(F.max("_share").alias("_share"), F.max(F.when(has(F.floor(place)), v)).alias("_low"), F.max(F.when(has(F.ceil(place)), v)).alias("_high"))
    edge = F.when(F.col("_share") == 0, F.col("_low")).otherwise((1 - F.col("_share")) * F.col("_low") + F.col("_share") * F.col("_high"))
    return ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", edge.alias("e")))).getField("e").alias("quantiles")).where("size(quantiles) > 0")  # n for each group


def band_of(value: Column, edges: Column) -> Column:
    """The last edge that isn't above the value, from 0; below the first edge is band 0."""
    return F.greatest(F.size(F.filter(edges, lambda e: value >= e)) - 1, F.lit(0))


def banded(df: DataFrame, keys: list[str], value: str, n: int = 4) -> DataFrame:
    """df's rows with a band and its bounds (the last has no upper one); rows without a value go."""
    joined = with_group(df.where(F.col(value).isNotNull()), quantile_edges(df, keys, value, n), keys)
    band = band_of(F.col(value), F.col("edges"))
    return joined.withColumn("band", band.cast("long")).withColumns({"low": F.col("edges")[F.col("band").cast("int")], "high": F.try_element_at("edges", (F.col("band") + 2).cast("int"))}).drop("edges")


def histogram(df: DataFrame, value: str, edges: list[float] | int) -> DataFrame:
    """Counts and shares of left-closed bins, empty ones too; edges: their left ends, or how many equal ones from the least value to the largest."""
    if isinstance(edges, int):
        low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
        edges = [low + i * (high - low) / edges for i in range(edges)] if low is not None else [0.0]
    at = F.array(*(F.lit(float(e)) for e in edges))
    counts = df.where(F.col(value).isNotNull()).groupBy(band_of(F.col(value), at).cast("long").alias("bin")).agg(F.count("*").alias("c"))
    bins = df.sparkSession.createDataFrame([(i, float(e), float(edges[i + 1]) if i + 1 < len(edges) else None) for i, e in enumerate(edges)], "bin long, low double, high double")
    out = bins.join(counts, "bin", "left").withColumn("count", F.coalesce("c", F.lit(0)))
    total = F.sum("count").over(W.partitionBy(F.lit(0)))  # one row for each bin
    return out.select("bin", "low", "high", "count", F.when(total > 0, F.col("count") / total).otherwise(0.0).alias("share"))


def bimodality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sarle's coefficient with sample corrections, from Spark's population skewness and kurtosis."""
    v, n = F.col(value), F.col("n")
    stats = df.groupBy(*keys).agg(F.count(v).cast("double").alias("n"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), F.var_pop(v).alias("m2")).where("n >= 4 AND m2 > 0")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return stats.select(*keys, n.cast("long").alias("n"), ((skew * skew + 1) / (kurt + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))).alias("bimodality"))


def concentration(df: DataFrame, keys: list[str], value: str, top: float = 0.2) -> DataFrame:
    """Gini, HHI and the share of the top items for each group; null where a value is negative or all are zero.

    Equal values are taken together, at the ranks that they fill.
    """
    v, c, below, n = (F.col(x) for x in (value, "_c", "_before", "_of"))
    shown = F.greatest(F.lit(1), F.bround(n * top).cast("long"))
    in_head = F.greatest(F.lit(0), F.least(c, shown - (n - below - c)))
    s = counted(df, keys, value).groupBy(*keys).agg(F.sum(c).alias("n"), F.sum(v * c).alias("total"), F.sum(v * (c * below + c * (c + 1) / 2)).alias("_w"), F.sum(v * v * c).alias("_sq"), F.min(v).alias("_min"), F.sum(v * in_head).alias("_head"))
    ok = (F.col("_min") >= 0) & (F.col("total") > 0)
    t = F.nullif(F.col("total"), F.lit(0.0))
    return s.select(*keys, "n", "total", F.when(ok, (2 * F.col("_w") - (F.col("n") + 1) * t) / (F.col("n") * t)).alias("gini"), F.when(ok, F.col("_sq") / (t * t)).alias("hhi"), F.when(ok, F.col("_head") / t).otherwise(0.0).alias("top_share"))


def pareto(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Each item's rank, share and cumulative share, largest first; groups with a negative value or no total have none."""
    rows = ranked(df.where(F.col(value).isNotNull()), keys, [F.desc(value), F.asc(item)], value)
    least = rows.groupBy(*keys).agg(F.min(value).alias("_min"))
    kept = with_group(rows, least, keys).where("_min >= 0 AND _total > 0")
    return kept.select(*keys, item, value, F.col("_rank").cast("long").alias("rank"), (F.col("_rank") / F.col("_size")).alias("cum_item_frac"), (F.col(value) / F.col("_total")).alias("share"), (F.col("_running") / F.col("_total")).alias("cum_share"))


def pareto_summary(curve: DataFrame, keys: list[str], reach: float = 0.8) -> DataFrame:
    """Items needed for `reach` of the value, and the share of the top tenth (at least one item)."""
    n = F.max("rank")
    each = with_group(curve, curve.groupBy(*keys).agg(n.alias("_n")), keys)
    return each.groupBy(*keys).agg(F.max("_n").alias("items"), F.min(F.when(F.col("cum_share") >= reach - 1e-12, F.col("rank"))).alias("items_for_80"), F.max(F.when(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * 0.1)), F.col("cum_share"))).alias("top_decile_share"))
