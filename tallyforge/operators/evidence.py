"""How far a finding can be trusted: grades of evidence, of precision, and what a reader is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least samples of strong and medium evidence; least samples and widest intervals of high and medium precision.
STRONG_N, MEDIUM_N = 30, 10
HIGH_RELIABLE, MEDIUM_RELIABLE = (100, 0.10), (30, 0.20)


def evidence_grade(n: Column, has_controls: Column, confounders: Column) -> Column:
    """Whether a number can carry a causal claim: strong, medium, weak or not_judgable."""
    return (
        F.when(n.isNull() | (n <= 0) | (confounders < 0), "not_judgable").when((n >= STRONG_N) & has_controls & (confounders == 0), "strong")
        .when((n >= MEDIUM_N) & has_controls & (confounders <= 1), "medium").otherwise("weak")
    )


def reliability(n: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """How well a number is known as a description: by its interval's width where there is one, else by its volume alone."""
    none = F.lit(None).cast("double")
    width = F.abs((none if high is None else high) - (none if low is None else low))
    level = lambda limit: (n >= limit[0]) & F.coalesce(width <= limit[1], F.lit(True))
    return F.when(n.isNull() | (n <= 0), "not_applicable").when(level(HIGH_RELIABLE), "high").when(level(MEDIUM_RELIABLE), "medium").otherwise("low")


def reader_confidence(evidence: Column, reliable: Column) -> Column:
    """One level for the reader: precision counts, evidence only where precision doesn't apply."""
    fallback = F.when(evidence == "strong", "high").when(evidence == "medium", "medium").otherwise("low")
    return F.when(evidence == "not_judgable", "not_judgable").when(reliable.isin("high", "medium", "low"), reliable).otherwise(fallback)


def confidence_tag(evidence: Column, reliable: Column, claim: Column) -> Column:
    """strong, medium or weak; a claim about a mechanism is never more than weak."""
    strong = (evidence == "strong") | (reliable == "high")
    return F.when(claim == "mechanism", "weak").when(F.coalesce(strong, F.lit(False)), "strong").when(reliable == "medium", "medium").otherwise("weak")


def expected_false_positives(tests: Column, alpha: float = 0.05) -> Column:
    return F.when((tests > 0) & F.lit(alpha > 0), tests * F.lit(alpha)).otherwise(0.0)
