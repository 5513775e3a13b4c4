"""Rules on facts as data: a row for each rule, all checked in one pass.

A rule names a metric and what must hold for its facts. Rules become conditional aggregates by group of keys, and these one row for each rule:
groups or rows that were checked, and how many fail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How metrics of a kind may be aggregated.
CALIBERS = {
    "user_count": ("direct", "mean_daily", "sum_as_person_days"),
    "order_count": ("direct", "sum", "mean_daily"),
    "money": ("direct", "sum", "mean_daily"),
    "ratio": ("direct", "mean_of_daily_ratios", "ratio_of_sums"),
}
#: Relative distance up to which values are one, as sums of floats depend on their order.
SAME = 1e-9
KINDS = ("unique", "unit", "owner", "caliber", "must_sum_to", "bounds", "known")


@dataclass(frozen=True)
class Rule:
    """kind: one of KINDS; args: unit, owner or caliber's name; total and tolerance; least and most."""

    name: str
    kind: str
    metric: str
    args: tuple = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of rule: {self.kind}")
        if self.kind == "caliber" and self.args[0] not in CALIBERS:
            raise ValueError(f"unknown caliber: {self.args[0]}")


def _by_row(rule: Rule) -> Column | None:
    """Whether a fact breaks the rule; none for rules on groups. A null breaks rules on what it should be."""
    value = F.col("value")
    breaks = {
        "unit": lambda: ~F.col("unit").eqNullSafe(rule.args[0]),
        "owner": lambda: ~F.coalesce(F.col("task_id").isin(*rule.args), F.lit(False)),
        "caliber": lambda: ~F.coalesce(F.col("aggregation").isin(*CALIBERS[rule.args[0]]), F.lit(False)),
        "bounds": lambda: F.coalesce((value < rule.args[0]) | (value > rule.args[1]) | F.isnan(value), F.lit(False)),
        "known": lambda: value.isNull() | F.isnan(value),
    }.get(rule.kind)
    return breaks() if breaks else None


def check(facts: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(rule, kind, metric, checked, failed, holds) of facts (keys, task_id, metric_key, value, unit, aggregation).

    unique: facts of a metric in a group have one value. must_sum_to: a group's facts sum to a total within a tolerance. Both count groups, all others facts. A rule
    without facts holds and has checked none.
    """
    parts = []
    for i, rule in enumerate(rules):
        mine = F.col("metric_key") == rule.metric
        n = F.count_if(mine)
        if (breaks := _by_row(rule)) is not None:
            checked, failed = n, F.count_if(mine & breaks)
        elif rule.kind == "unique":
            value = F.when(mine, F.col("value"))
            apart = F.max(value) - F.min(value) > SAME * F.greatest(F.abs(F.max(value)), F.abs(F.min(value)))
            checked, failed = (n > 0).cast("long"), F.coalesce(apart, F.lit(False)).cast("long")
        else:
            total, tolerance = rule.args
            gap = F.abs(F.coalesce(F.sum(F.when(mine, F.col("value"))), F.lit(0.0)) - total)
            checked, failed = (n > 0).cast("long"), ((n > 0) & ~F.coalesce(gap <= tolerance, F.lit(False))).cast("long")
        parts += [checked.alias(f"_c{i}"), failed.alias(f"_f{i}")]
    by_group = facts.groupBy(*keys).agg(*parts)
    sums = by_group.agg(*(F.coalesce(F.sum(f"_{x}{i}"), F.lit(0)).alias(f"_{x}{i}") for i in range(len(rules)) for x in "cf"))
    rows = (
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.metric).alias("metric"), F.col(f"_c{i}").alias("checked"), F.col(f"_f{i}").alias("failed"))
        for i, r in enumerate(rules)
    )
    return sums.select(F.inline(F.array(*rows))).withColumn("holds", F.col("failed") == 0)
