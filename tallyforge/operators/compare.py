"""Group comparisons: top two groups, strata, means, and families of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import statistics as S
from tallyforge.operators.ranks import ranked, with_group
from tallyforge.sources.staging import stored


def top2_compare(df: DataFrame, keys: list[str], group: str, k: str, n: str) -> DataFrame:
    """The two groups with the largest n, compared: difference, z, lift and least detectable effect."""
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    top = df.where(F.col(n) > 0).withColumn("_r", F.row_number().over(by.orderBy(F.desc(n), group))).where("_r <= 2")
    side = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    wide = top.groupBy(*keys).agg(side(1, group).alias("group_1"), side(2, group).alias("group_2"), *(side(r, c).cast("double").alias(f"{a}{r}") for a, c in (("k", k), ("n", n)) for r in (1, 2))).where("group_2 IS NOT NULL")
    args = [F.col(c) for c in ("k1", "n1", "k2", "n2")]
    test, lift = S.two_proportion(*args), S.relative_lift(*args)
    mde = S.min_detectable_effect(F.col("n1"), F.col("n2"), F.col("k2") / F.nullif(F.col("n2"), F.lit(0.0)))
    return wide.select(*keys, "group_1", "group_2", *args, *(c.alias(name) for name, c in (test | lift | {"mde": mde}).items()))


def stratified(df: DataFrame, keys: list[str]) -> DataFrame:
    """Cochran-Mantel-Haenszel over rows (k1, n1, k2, n2), one for each stratum."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    k1, k2 = S.clamp(F.col("k1"), n1), S.clamp(F.col("k2"), n2)
    t, m = n1 + n2, k1 + k2
    used = df.where((n1 > 0) & (n2 > 0) & (t > 1) & F.col("k1").isNotNull() & F.col("k2").isNotNull())
    s = used.groupBy(*keys).agg(
        F.sum(k1).alias("a"), F.sum(n1 * m / t).alias("e"), F.sum(n1 * n2 * m * (t - m) / (t * t * (t - 1))).alias("v"), F.sum(n1 * n2 / t * (k1 / n1 - k2 / n2)).alias("dn"), F.sum(n1 * n2 / t).alias("dd"), F.count("*").alias("n_strata"),
    )
    gap = F.abs(F.col("a") - F.col("e")) - 0.5
    chi = F.when(F.col("v") > 0, gap * gap / F.nullif(F.col("v"), F.lit(0.0)))
    return s.select(*keys, F.when(F.col("v") > 0, F.col("dn") / F.nullif(F.col("dd"), F.lit(0.0))).alias("pooled_diff"), chi.alias("mh_chi2"), F.coalesce(chi >= S.CHI2, F.lit(False)).alias("significant"), "n_strata")


def mean_difference(df: DataFrame, keys: list[str], side: Column, value: str) -> DataFrame:
    """Welch's test between rows where side is true and where it is false."""
    v = F.col(value)
    part = lambda f, s: f(F.when(side if s else ~side, v))
    s = df.groupBy(*keys).agg(*(part(f, a).alias(f"{name}_{'a' if a else 'b'}") for a in (True, False) for name, f in (("mean", F.avg), ("_v", F.var_samp), ("_n", F.count)))).where("_n_a >= 2 AND _n_b >= 2")
    a, b = F.col("_v_a") / F.col("_n_a"), F.col("_v_b") / F.col("_n_b")
    se = F.nullif(F.sqrt(a + b), F.lit(0.0))
    diff = F.col("mean_a") - F.col("mean_b")
    df_ = (a + b) * (a + b) / F.nullif(a * a / (F.col("_n_a") - 1) + b * b / (F.col("_n_b") - 1), F.lit(0.0))
    return s.select(*keys, "mean_a", "mean_b", diff.alias("diff"), (diff / se).alias("t"), df_.alias("df"), F.coalesce(F.abs(diff / se) >= S.Z, F.lit(False)).alias("significant"), (diff - S.Z * se).alias("ci_low"), (diff + S.Z * se).alias("ci_high"))


def false_discovery(df: DataFrame, family: list[str], p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """df with fdr_significant by Benjamini and Hochberg within each family; null p never is."""
    rows = ranked(df.withColumn("_known", F.col(p).isNotNull().cast("int")), family, [F.asc_nulls_last(p), F.asc(tie)], "_known")
    passes = F.col(p) <= F.col("_rank") / F.nullif(F.col("_total"), F.lit(0.0)) * alpha
    last = rows.groupBy(*family).agg(F.max(F.when(passes, F.col("_rank"))).alias("_last"))
    out = with_group(rows, last, family).withColumn("fdr_significant", F.col(p).isNotNull() & F.coalesce(F.col("_rank") <= F.col("_last"), F.lit(False)))
    return out.drop("_known", "_rank", "_size", "_running", "_total", "_last")


def rate_outliers(df: DataFrame, family: list[str], item: str, k: str, n: str) -> DataFrame:
    """Items of at least 30 trials against their family's pooled rate, with false-discovery control."""
    rows = stored(df, "rates")
    base = rows.groupBy(*family).agg((F.sum(k) / F.nullif(F.sum(n).cast("double"), F.lit(0.0))).alias("baseline"))
    lo, hi = S.wilson(F.col(k), F.col(n))
    tested = with_group(rows.where(S.enough(F.col(n))), base, family).withColumns({"rate": F.col(k) / F.col(n), "wilson_low": lo, "wilson_high": hi, "p_value": S.one_sided_binomial_p(F.col(k), F.col(n), F.col("baseline"))})
    return false_discovery(tested, family, "p_value", item)
