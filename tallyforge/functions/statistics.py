"""Statistics on aggregated counts, as Column expressions: they add no shuffle to the plan that made the counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % quantile, 80 % power quantile, chi-square with 1 degree at 5 %, least n of a rate.
Z, Z_POWER, CHI2, MIN_N = 1.96, 0.84, 3.841, 30
# Coefficients of the Chebyshev fit of erfc (Press et al., Numerical Recipes, erfcc).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def clamp(k: Column, n: Column) -> Column:
    return F.least(F.greatest(k.cast("double"), F.lit(0.0)), n.cast("double"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; k is clamped to 0..n, and n of 0 or less gives (0, 0)."""
    p = clamp(k, n) / n
    denom = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denom
    margin = z / denom * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), center - margin)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), center + margin)).otherwise(0.0)


def enough(n: Column) -> Column:
    return F.coalesce(n >= MIN_N, F.lit(False))


def two_proportion(k1: Column, n1: Column, k2: Column, n2: Column) -> dict[str, Column]:
    ok = (n1 > 0) & (n2 > 0)
    a, b = clamp(k1, n1), clamp(k2, n2)
    pooled = (a + b) / (n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    z = F.when(ok & (se > 0), (a / n1 - b / n2) / F.nullif(se, F.lit(0.0)))
    (lo1, hi1), (lo2, hi2) = wilson(k1, n1), wilson(k2, n2)
    return {
        "diff": F.when(ok, a / n1 - b / n2),
        "z": z,
        "significant": F.coalesce(F.abs(z) >= Z, F.lit(False)),
        "ci_overlap": F.when(ok, ~((hi1 < lo2) | (hi2 < lo1))).otherwise(True),
    }


def relative_lift(k1: Column, n1: Column, k2: Column, n2: Column) -> dict[str, Column]:
    """p1 / p2 - 1, with bounds from the worst corners of the two Wilson intervals."""
    ok = (n1 > 0) & (n2 > 0) & (clamp(k2, n2) > 0)
    (lo1, hi1), (lo2, hi2) = wilson(k1, n1), wilson(k2, n2)
    return {
        "lift": F.when(ok, clamp(k1, n1) / n1 / F.nullif(clamp(k2, n2) / n2, F.lit(0.0)) - 1),
        "lift_ci_low": F.when(ok & (hi2 > 0), lo1 / F.nullif(hi2, F.lit(0.0)) - 1),
        "lift_ci_high": F.when(ok & (lo2 > 0), hi1 / F.nullif(lo2, F.lit(0.0)) - 1),
    }


def min_detectable_effect(n1: Column, n2: Column, p: Column) -> Column:
    return F.when((n1 > 0) & (n2 > 0) & (p > 0) & (p < 1), (Z + Z_POWER) * F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))


def erfc(x: Column) -> Column:
    """For x of 0 or more; relative error below 1.2e-7."""
    t = 1 / (1 + x / 2)
    poly: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


def one_sided_binomial_p(k: Column, n: Column, p0: Column) -> Column:
    """Upper tail by the normal approximation with continuity correction; 1 where nothing is to be tested."""
    p = clamp(k, n) / n
    z = (p - p0 - 0.5 / n) / F.sqrt(p0 * (1 - p0) / n)
    return F.when((n > 0) & (p0 > 0) & (p0 < 1), F.when((p > p0) & (z > 0), 0.5 * erfc(z / 2**0.5)).otherwise(1.0)).otherwise(1.0)


def gated(significant: Column, diff: Column, least: float) -> Column:
    """Significant and large enough to matter."""
    return significant & F.coalesce(F.abs(diff) >= least, F.lit(False))
