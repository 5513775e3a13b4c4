"""One-to-one assignment of headers to canonical columns, for all files at once, with an audit of how it came about.

Every header is scored against every canonical column of its file's table. In each round, pairs that are best for both sides are chosen and
leave with all their other pairs; rounds go on until no pair is left, at most as many as a table has columns. Ties go to the name
first in order, so that the result is that of taking pairs by falling score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.sources.harmonise import aliases, fold_name
from tallyforge.sources.staging import stored

# Scores of an override, a canonical name, a shipped spelling; least similarity of others; a lead under which a choice is ambiguous.
OVERRIDE, EXACT, ALIAS, LEAST, LEAD = 2.0, 1.0, 0.95, 0.8, 0.05


def similarity(a: Column, b: Column) -> Column:
    """Share of letters that needn't change."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def scored(headers: DataFrame, spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(file, table_name, column, canonical, score) of headers(file, table_name, column) that are near enough."""
    names = aliases(spark, overrides).groupBy("table_name", "folded", "canonical").agg(F.min("rank").alias("rank"))  # a row for each spelling of the contracts
    rows = headers.select("file", "table_name", "column", fold_name(F.col("column")).alias("_h")).distinct()
    pairs = rows.join(names.withColumnRenamed("folded", "_n"), "table_name")
    known = F.element_at(F.array(F.lit(OVERRIDE), F.lit(EXACT), F.lit(ALIAS)), F.col("rank") + 1)
    score = F.when(F.col("_h") == F.col("_n"), known).otherwise(F.least(similarity(F.col("_h"), F.col("_n")), F.lit(ALIAS - 0.01)))
    best = pairs.withColumn("score", F.round(score, 6)).where(F.col("score") >= LEAST)
    return best.groupBy("file", "table_name", "column", "canonical").agg(F.max("score").alias("score"))


def assigned(pairs: DataFrame) -> DataFrame:
    """(file, table_name, column, canonical, score, round) of the pairs that rounds of mutual best choose."""
    left, out, turn = stored(pairs, "matching-pairs"), None, 0
    while not left.isEmpty():
        turn += 1
        by_header = W.partitionBy("file", "column").orderBy(F.desc("score"), "canonical")
        by_name = W.partitionBy("file", "canonical").orderBy(F.desc("score"), "column")
        best = left.withColumns({"_a": F.row_number().over(by_header), "_b": F.row_number().over(by_name)}).where("_a = 1 AND _b = 1")
        chosen = stored(best.drop("_a", "_b").withColumn("round", F.lit(turn)), "matching-chosen")
        out = chosen if out is None else out.unionByName(chosen)
        rest = left.join(chosen.select("file", "column"), ["file", "column"], "left_anti").join(chosen.select("file", "canonical"), ["file", "canonical"], "left_anti")
        left = stored(rest, "matching-pairs")
    return out if out is not None else pairs.withColumn("round", F.lit(0))


def audit(headers: DataFrame, spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """A row for each header (file, table_name, column, canonical, score, outcome, instead_of).

    outcome: ``review`` where only likeness speaks for the choice (it isn't applied by itself), ``ambiguous`` where the next choice is within LEAD,
    ``conflicting`` where the header's best name went to another header, else ``chosen``; ``unmatched`` without any. instead_of: the name lost or the next choice.
    """
    pairs = stored(scored(headers, spark, overrides), "matching-scored")
    chosen = assigned(pairs)
    first = W.partitionBy("file", "column").orderBy(F.desc("score"), "canonical")
    ranked = pairs.withColumn("_r", F.row_number().over(first)).where("_r <= 2")
    two = ranked.groupBy("file", "column").agg(
        F.max(F.when(F.col("_r") == 1, F.col("canonical"))).alias("_best"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("_top"),
        F.max(F.when(F.col("_r") == 2, F.col("canonical"))).alias("_second"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("_next"),
    )
    rows = headers.select("file", "table_name", "column").distinct().join(chosen.drop("table_name"), ["file", "column"], "left").join(two, ["file", "column"], "left")
    lost = F.col("_best").isNotNull() & ~F.col("_best").eqNullSafe(F.col("canonical"))
    close = F.col("_next").isNotNull() & (F.col("_top") - F.col("_next") < LEAD)
    outcome = F.when(F.col("_best").isNull(), "unmatched").when(lost, "conflicting").when(close, "ambiguous").when(F.col("score") < ALIAS, "review").otherwise("chosen")
    instead = F.when(outcome == "conflicting", F.col("_best")).when(outcome == "ambiguous", F.col("_second"))
    return rows.select("file", "table_name", "column", "canonical", "score", outcome.alias("outcome"), instead.alias("instead_of"))
