"""Findings as facts: flattened, identified, validated, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Unit of a metric by its name, in the order they are tried.
UNITS = (
    ("count", "_observed_days$"),
    ("person_day", "_(buyer|visitor|user)_days$"),
    ("percent", "rate|share|pct"),
    ("index", "_(hhi|gini)$"),
    ("money", "gmv|amount|aov|spend"),
)
EVIDENCE, RELIABILITY = 0.6, 0.4


def flatten(wide: DataFrame, keys: list[str], task: str) -> DataFrame:
    """(keys, task_id, metric_key, value): a row for each number of a task's result."""
    names = [c for c, t in wide.dtypes if c not in keys and t in ("double", "bigint", "int", "float")]
    rows = F.array(*(F.struct(F.lit(c).alias("metric_key"), F.col(c).cast("double").alias("value")) for c in names))
    return wide.select(*keys, F.lit(task).alias("task_id"), F.inline(rows))


def unit_of(metric: Column) -> Column:
    out: Column = F.lit("count")
    for unit, pattern in reversed(UNITS):
        out = F.when(metric.rlike(pattern), unit).otherwise(out)
    return out


def identified(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds fact_id, which names the task only where several tasks have the metric, and the unit."""
    several = F.count("*").over(W.partitionBy(*keys, "metric_key")) > 1
    return rows.withColumns({"fact_id": F.when(several, F.concat_ws(".", "task_id", "metric_key")).otherwise(F.col("metric_key")), "unit": unit_of(F.col("metric_key"))})


def conflicting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fact ids with more than one value."""
    return rows.groupBy(*keys, "fact_id").agg(F.countDistinct("value").alias("values")).where("values > 1")


def validated(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds status: ok, unregistered, or unit where it isn't the registered one."""
    joined = rows.join(registry, "metric_key", "left")
    return joined.withColumn("status", F.when(F.col("registered_unit").isNull(), "unregistered").when(F.col("registered_unit") != F.col("unit"), "unit").otherwise("ok"))


def must_sum_to(rows: DataFrame, keys: list[str], value: str, total: float, tolerance: float = 1e-6) -> DataFrame:
    return rows.groupBy(*keys).agg((F.abs(F.sum(value) - total) <= tolerance).alias("sums_to_one"))


def coverage(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(F.bool_or("judgable").alias("producible"), F.count_if("judgable").alias("judgable_findings"))


def priority(findings: DataFrame, weights: DataFrame, keys: list[str], shown: int) -> DataFrame:
    """The best judgable finding of each task by lever weight times feasibility, the first `shown` of each key."""
    score = F.col("weight") * (EVIDENCE * F.col("evidence") + RELIABILITY * F.col("reliability"))
    rows = findings.where("judgable").join(weights, "lever").withColumn("score", score)
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "task_id").orderBy(F.desc("score"), "lever"))).where("_r = 1").select(*keys, "task_id", "lever", "score")
    if not keys:
        return best.orderBy(F.desc("score"), "task_id").limit(shown)
    return best.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "task_id"))).where(f"_r <= {shown}").drop("_r")


def content_hash(rows: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """One hash of all facts of a key, in any row order: numbers to so many places, hashed by row, then the sum of the hashes, which needs no list."""
    row = F.sha2(F.concat_ws("|", "task_id", "fact_id", F.format_string(f"%.{digits}f", F.col("value"))), 256)
    number = F.conv(F.substring(row, 1, 14), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.sha2(F.sum(number).cast("string"), 256).alias("content_hash"))
