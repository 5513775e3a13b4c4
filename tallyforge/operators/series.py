"""Grouped time-series operators: each takes (df, keys, period, value) and works per group; keys=[] is one series.

A group's series goes to one task, as windows need; for one very long ungrouped series use ranks.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.staging import stored

from tallyforge.functions.cleaning import direction, pct_change

T_LEAST, EPS, DETREND_POINTS, ANOMALY_POINTS = 2.0, 1e-9, 14, 7


def _by(keys: list[str]):  # noqa: ANN202
    return W.partitionBy(*[F.col(k) for k in keys]) if keys else W.partitionBy(F.lit(0))


def mom_change(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Adds delta, pct and direction against the period before."""
    before = F.lag(value).over(_by(keys).orderBy(period))
    delta = F.col(value) - before
    return df.withColumns({"delta": delta, "pct": pct_change(before, F.col(value)), "direction": direction(F.coalesce(delta, F.lit(0.0)))})


def weeks_by_rows(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Buckets of seven rows each, in order; a last bucket that isn't full is dropped."""
    numbered = df.withColumn("_week", F.floor((F.row_number().over(_by(keys).orderBy(day)) - 1) / 7).cast("long"))
    weeks = numbered.groupBy(*keys, "_week").agg(F.min(day).alias("week_start"), F.max(day).alias("week_end"), F.sum(value).alias("total"), F.count("*").alias("_n")).where("_n = 7").drop("_n")
    return mom_change(weeks.withColumnRenamed("_week", "week"), keys, "week", "total")


def weeks_by_calendar(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """ISO weeks with their totals and how many rows they have."""
    dated = df.where(F.col(day).isNotNull()).withColumns({"iso_year": F.extract(F.lit("YEAROFWEEK"), F.col(day)).cast("long"), "iso_week": F.weekofyear(day).cast("long")})
    weeks = dated.groupBy(*keys, "iso_year", "iso_week").agg(F.min(day).alias("week_start"), F.max(day).alias("week_end"), F.count("*").alias("days_in_bucket"), F.sum(value).alias("total"))
    return mom_change(weeks.withColumn("_p", F.col("iso_year") * 100 + F.col("iso_week")), keys, "_p", "total").drop("_p")


def moving_average(df: DataFrame, keys: list[str], period: str, value: str, k: int, name: str = "moving_avg") -> DataFrame:
    """Mean of the 2k+1 rows around each, fewer at the ends."""
    return df.withColumn(name, F.avg(value).over(_by(keys).orderBy(period).rowsBetween(-k, k)))


def indexed(df: DataFrame, keys: list[str], period: str) -> DataFrame:
    return df.withColumn("_i", (F.row_number().over(_by(keys).orderBy(period)) - 1).cast("double"))


def trend_summary(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Least-squares slope over the row number with its standard error and t; a perfect fit has an infinite t."""
    i, v = F.col("_i"), F.col(value)
    stats = indexed(df, keys, period).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("_mean"), F.regr_slope(v, i).alias("slope"), F.regr_sxx(v, i).alias("_sxx"), F.regr_syy(v, i).alias("_syy"), F.regr_sxy(v, i).alias("_sxy"),
        F.min_by(v, i).alias("first_value"), F.max_by(v, i).alias("last_value"), F.min(period).alias("start_period"), F.max(period).alias("end_period"),
    )
    slope = F.coalesce("slope", F.lit(0.0))
    residual = F.when((F.col("n") >= 3) & (F.col("_sxx") > 0), F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))) / F.nullif(F.col("n") - 2, F.lit(0)))
    se = F.when(residual <= EPS, 0.0).otherwise(F.sqrt(residual / F.nullif(F.col("_sxx"), F.lit(0.0))))
    t = F.when(residual <= EPS, F.when(F.abs(slope) > EPS, float("inf")).otherwise(0.0)).otherwise(slope / F.nullif(se, F.lit(0.0)))
    out = stats.withColumns({"slope": slope, "slope_se": se, "t_stat": t})
    return out.select(
        *keys, "n", direction(F.col("slope")).alias("direction"), "slope", "first_value", "last_value", (F.col("_mean") + F.col("slope") * (F.col("n") - 1) / 2).alias("fitted_last"), "start_period", "end_period",
        "slope_se", "t_stat", F.coalesce(F.abs("t_stat") >= T_LEAST, F.lit(False)).alias("significant"), F.when(F.col("_mean") != 0, F.col("slope") * (F.col("n") - 1) / F.col("_mean")).alias("rel_slope"),
    )


def trend_projection(summary: DataFrame, horizon: int = 7, non_negative: bool = False) -> DataFrame:
    """The fitted line, horizon steps on, for significant trends over four points or more."""
    projected = F.col("fitted_last") + F.col("slope") * horizon
    kept = summary.where("n >= 4 AND significant")
    return kept.withColumns({"horizon": F.lit(horizon).cast("long"), "projected_value": F.greatest(projected, F.lit(0.0)) if non_negative else projected})


def residuals(df: DataFrame, keys: list[str], period: str, value: str, name: str = "residual") -> DataFrame:
    """Distance from the least-squares line over the row number; of one row, the value itself."""
    i, v, by = F.col("_i"), F.col(value), _by(keys)
    n = F.count(v).over(by)
    fitted = F.regr_intercept(v, i).over(by) + F.regr_slope(v, i).over(by) * i
    return indexed(df, keys, period).withColumn(name, F.when(n < 2, v).otherwise(v - fitted)).drop("_i")


def weekday_seasonality(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Mean residual of each weekday (0 Monday), of levels where a series has under 14 points, with peak and trough."""
    n = F.count("*").over(_by(keys))
    level = residuals(df, keys, day, value).withColumn("_long", n >= DETREND_POINTS).withColumn("_x", F.when(F.col("_long"), F.col("residual")).otherwise(F.col(value)))
    means = level.groupBy(*keys, F.weekday(day).cast("long").alias("weekday")).agg(F.avg("_x").alias("mean_level"), F.first("_long").alias("detrended"))
    order = _by(keys)
    first = lambda c: F.row_number().over(order.orderBy(c, "weekday")) == 1
    return means.withColumns({"is_peak": first(F.desc("mean_level")), "is_trough": first(F.asc("mean_level"))})


def anomaly_days(df: DataFrame, keys: list[str], day: str, value: str, sigma: float = 2.0) -> DataFrame:
    """Days whose residual lies sigma standard deviations or more from the mean residual."""
    by = _by(keys)
    z = (F.col("residual") - F.avg("residual").over(by)) / F.nullif(F.stddev_pop("residual").over(by), F.lit(0.0))
    scored = residuals(df, keys, day, value).withColumns({"z": z, "_n": F.count("*").over(by), "_s": F.stddev_pop("residual").over(by)})
    kept = scored.where((F.col("_n") >= ANOMALY_POINTS) & (F.col("_s") > EPS) & (F.abs("z") >= sigma))
    return kept.select(*keys, day, value, "residual", "z", F.when(F.col("z") > 0, "above").otherwise("below").alias("direction"))


def _splits(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """For rows indexed by _i from 0 within keys: the best split of each group (first of the largest shifts)."""
    by = _by(keys)
    n, total = F.count("*").over(by), F.sum(value).over(by)
    before = F.sum(value).over(by.orderBy("_i").rowsBetween(W.unboundedPreceding, -1))
    i = F.col("_i") - F.min("_i").over(by)
    rows = df.withColumns({"_k": i, "_n": n, "_t": total, "_b": before}).where(f"_k >= {least} AND _n - _k >= {least}")
    rows = rows.withColumns({"before_mean": F.col("_b") / F.col("_k"), "after_mean": (F.col("_t") - F.col("_b")) / (F.col("_n") - F.col("_k"))}).withColumn("shift", F.col("after_mean") - F.col("before_mean"))
    best = rows.withColumn("_r", F.row_number().over(by.orderBy(F.abs("shift").desc(), "_i"))).where("_r = 1")
    return best.select(*keys, F.col("_i").cast("long").alias("index"), "before_mean", "after_mean", "shift")


def changepoint(df: DataFrame, keys: list[str], period: str, value: str, least: int = 3) -> DataFrame:
    """The split with the largest shift of the mean; none for series of under 2 * least points."""
    return _splits(indexed(df, keys, period), keys, value, least)


def changepoints(df: DataFrame, keys: list[str], period: str, value: str, least: int = 3, most: int = 3, least_shift: float = 0.15) -> DataFrame:
    """Up to `most` splits by halving again and again, left parts before right ones.

    A part's path of L and R gives its place in that order, so each level is one pass over all series.
    """
    rows = indexed(df, keys, period).withColumn("_scale", F.abs(F.avg(value).over(_by(keys))))
    rows = rows.select(*keys, "_i", value, F.when(F.col("_scale") == 0, 1.0).otherwise(F.col("_scale")).alias("_scale"), F.lit("").alias("_path"))
    found, part = None, [*keys, "_path"]
    for _ in range(most):
        rows = stored(rows, "changepoints")  # each level reads it several times
        scale = rows.groupBy(*part).agg(F.first("_scale").alias("_scale"))
        level = stored(_splits(rows.drop("_scale"), part, value, least).join(scale, part).withColumn("rel_shift", F.abs("shift") / F.col("_scale")).where(F.col("rel_shift") >= least_shift).drop("_scale"), "changepoints-level")
        found = level if found is None else found.unionByName(level)
        cut = level.select(*part, F.col("index").alias("_at"))
        rows = rows.join(cut, part).withColumn("_path", F.concat("_path", F.when(F.col("_i") < F.col("_at"), "L").otherwise("R"))).drop("_at")
    order = _by(keys).orderBy("_path")
    return found.withColumn("_r", F.row_number().over(order)).where(f"_r <= {most}").drop("_r", "_path")


def running_total(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    return df.withColumn(value, F.sum(value).over(_by(keys).orderBy(period)))


def gated_direction(summary: DataFrame) -> DataFrame:
    """A trend summary whose direction is unclear unless the slope is significant."""
    return summary.withColumn("direction", F.when(F.coalesce("significant", F.lit(False)), F.col("direction")).otherwise("unclear"))


def self_percentile(df: DataFrame, keys: list[str], value: str, name: str = "self_percentile") -> DataFrame:
    """Midrank of each value within its group's finite values."""
    v = F.col(value)
    good = F.when(v.isNotNull() & ~F.isnan(v), v)
    n = F.count(good).over(_by(keys))
    below = F.rank().over(_by(keys).orderBy(good.asc_nulls_last())) - 1
    equal = F.count(good).over(W.partitionBy(*keys, value))
    return df.withColumn(name, F.when(good.isNotNull(), (below + 0.5 * equal) / n))


def latest_benchmark(df: DataFrame, keys: list[str], day: str, value: str, least_weeks: int = 4) -> DataFrame:
    """The latest full ISO week's total against the group's own weeks; a week of under seven rows at the end is dropped."""
    weeks = weeks_by_calendar(df, keys, day, value)
    order = _by(keys).orderBy(F.desc("iso_year"), F.desc("iso_week"))
    full = weeks.withColumn("_r", F.row_number().over(order)).where("NOT (_r = 1 AND days_in_bucket < 7)").drop("_r")
    ranked = self_percentile(full, keys, "total").withColumns({"_r": F.row_number().over(order), "periods": F.count("*").over(_by(keys))})
    return ranked.where(f"_r = 1 AND periods >= {least_weeks}").select(*keys, "iso_year", "iso_week", "total", "self_percentile", "periods")


def islands(df: DataFrame, keys: list[str], order: str, state: list[str], label: str) -> DataFrame:
    """Adjacent rows with the same state as one row: first and last order, rows, and the labels."""
    by = _by(keys).orderBy(order)
    changed = ~F.lag(F.struct(*state)).over(by).eqNullSafe(F.struct(*state))
    marked = df.withColumn("_island", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(by))
    return marked.groupBy(*keys, "_island", *state).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels")).drop("_island")


