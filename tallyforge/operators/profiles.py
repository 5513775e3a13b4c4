"""Profiles of all columns of a table as sketches: made in one pass, kept by file or day, merged at will.

Rows, nulls, least, most and sum are exact and merge exactly. Distinct values are a HyperLogLog sketch (RSE about 1.04 / sqrt(2^LG_HLL)), quantiles
of numbers a KLL sketch (rank error about 1.3 % at K_KLL), frequent values a top-k sketch that holds ITEMS values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_HLL, K_KLL, ITEMS, SHOWN = 14, 200, 1000, 5
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
SKETCH = ("rows", "nulls", "least", "most", "total", "distinct_sketch", "quantile_sketch", "top_sketch")


def sketches(df: DataFrame, keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(keys, column, is_number and SKETCH) with a row for each column; keys: what parts are kept by. All columns share one pass."""
    keys = keys or []
    kinds = dict(df.dtypes)
    columns = columns or [c for c in df.columns if c not in keys and not kinds[c].startswith(("array", "map", "struct", "binary"))]
    found = [_sketch(c, kinds[c].split("(")[0] in NUMBERS).alias(f"_{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*keys).agg(*found)
    return wide.select(*keys, F.inline(F.array(*(F.col(f"_{i}") for i in range(len(columns))))))


def _sketch(name: str, number: bool) -> Column:
    c = F.col(f"`{name}`")
    text, value = c.cast("string"), c.cast("double") if number else F.lit(None).cast("double")
    # NaN and infinities are counted as values but are no numbers
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value) if number else value
    return F.struct(
        F.lit(name).alias("column"),
        F.lit(number).alias("is_number"),
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count(c)).alias("nulls"),
        F.min(finite if number else text).cast("string").alias("least"),
        F.max(finite if number else text).cast("string").alias("most"),
        F.sum(finite).alias("total"),
        F.hll_sketch_agg(text, LG_HLL).alias("distinct_sketch"),
        F.kll_sketch_agg_double(finite, K_KLL).alias("quantile_sketch") if number else F.lit(None).cast("binary").alias("quantile_sketch"),
        F.call_function("approx_top_k_accumulate", text, F.lit(ITEMS)).alias("top_sketch"),
    )


def merge(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sketches of parts to those of their union, by keys (none: of all) and column."""
    number = F.col("is_number")
    as_number = lambda f, c: f(F.when(number, F.col(c).cast("double"))).cast("string")
    return parts.groupBy(*(keys or []), "column", "is_number").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.coalesce(as_number(F.min, "least"), F.min(F.when(~number, F.col("least")))).alias("least"),
        F.coalesce(as_number(F.max, "most"), F.max(F.when(~number, F.col("most")))).alias("most"),
        F.sum("total").alias("total"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(ITEMS)).alias("top_sketch"),
    )


def described(parts: DataFrame, keys: list[str] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), shown: int = SHOWN) -> DataFrame:
    """What sketches say: null share, distinct values, mean, quantiles and the most frequent values with their counts."""
    n = F.kll_sketch_get_n_double("quantile_sketch")
    at = {f"p{round(q * 100)}": F.when(F.col("is_number") & (n > 0), F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))) for q in quantiles}
    top = F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(shown))
    return parts.select(
        *(keys or []), "column", "rows", "nulls", (F.col("nulls") / F.col("rows")).alias("null_share"), F.hll_sketch_estimate("distinct_sketch").alias("distinct"),
        "least", "most", F.when(n > 0, F.col("total") / n).alias("mean"), *(c.alias(name) for name, c in at.items()), top.alias("top"),
    )
