"""Files of exported tables to canonical tables: classify, map headers, merge by grain, report.

The headers of all landed files are one DataFrame (file, column), joined to the contracts; only these
metadata are looked at before the rows, which go through one job for each table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import is_finite, is_missing, optional_text, parse_quantity, parse_timestamp, to_finite
from tallyforge.sources.contracts import CONTRACTS, Contract

# Least share of a signature, least lead over the next table, relative gap of a conflict.
LEAST_COVER, LEAST_LEAD, CONFLICT = 0.25, 0.15, 0.05
# Refund states whose orders don't count as sales.
REFUNDED = ("refund", "refunded", "refund_success", "partial_refund", "cancelled", "canceled", "已退款", "退款成功", "部分退款", "已取消", "取消")


def fold_name(c: Column) -> Column:
    """Header text with case, blanks, dashes and full-width marks folded."""
    return F.regexp_replace(F.translate(F.lower(F.trim(c)), "（）：－—　", "():-- "), r"[\s_-]+", "_")


def counts_as_sale(status: Column) -> Column:
    """Whether an order line in this state is a sale; an unknown state is."""
    return status.isNull() | ~F.lower(F.trim(status.cast("string"))).isin(*REFUNDED)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, with the file each row came from and its place."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    return df.withColumns({"_source_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})


def profile(df: DataFrame) -> dict:
    return {"columns": df.columns, "rows": df.count(), "sample": [r.asDict() for r in df.limit(5).collect()]}


def signatures(spark: SparkSession, contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    return spark.createDataFrame([(c.name, s, len(c.signature)) for c in contracts.values() for s in c.signature], "table_name string, canonical string, size int")


def aliases(spark: SparkSession, overrides: DataFrame | None = None, contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    """(table_name, folded, canonical, rank): canonical names, then shipped spellings; overrides come first and only add."""
    rows = [(c.name, n, n, 1) for c in contracts.values() for n in c.columns] + [(c.name, a, n, 2) for c in contracts.values() for a, n in c.aliases.items()]
    shipped = spark.createDataFrame(rows, "table_name string, folded string, canonical string, rank int")
    extra = overrides.select("table_name", fold_name(F.col("header")).alias("folded"), "canonical", F.lit(0).alias("rank")) if overrides is not None else shipped.limit(0)
    return shipped.unionByName(extra).distinct()


def classify(headers: DataFrame, spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(file, table_name, cover, hits, status) for each file of headers(file, column): its best table, if clear."""
    known = signatures(spark).join(aliases(spark, overrides), ["table_name", "canonical"])
    hits = headers.withColumn("folded", fold_name(F.col("column"))).join(known, "folded").groupBy("file", "table_name").agg(F.countDistinct("canonical").alias("hits"), F.max("size").alias("size"))
    by = W.partitionBy("file").orderBy(F.desc("cover"), F.desc("hits"), "table_name")
    ranked = hits.withColumn("cover", F.col("hits") / F.col("size")).withColumns({"r": F.row_number().over(by), "next": F.coalesce(F.lead("cover").over(by), F.lit(0.0)), "next_hits": F.coalesce(F.lead("hits").over(by), F.lit(0))})
    clear = (F.col("cover") - F.col("next") >= LEAST_LEAD) | (F.col("hits") > F.col("next_hits"))
    best = ranked.where("r = 1").withColumn("status", F.when(F.col("cover") < LEAST_COVER, "needs_data").when(~clear, "ambiguous").otherwise("classified"))
    return headers.select("file").distinct().join(best.select("file", "table_name", "cover", "hits", "status"), "file", "left").withColumn("status", F.coalesce("status", F.lit("needs_data")))


def map_headers(headers: DataFrame, files: DataFrame, spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(file, table_name, column, canonical, how): each source used once, by rank; what isn't known keeps a folded name, numbered where it is taken."""
    rows = headers.join(files.where("status = 'classified'").select("file", "table_name"), "file").withColumn("folded", fold_name(F.col("column")))
    known = rows.join(aliases(spark, overrides), ["table_name", "folded"], "left")
    once = W.partitionBy("file", "canonical").orderBy("rank", "column")
    ranked = known.withColumn("r", F.when(F.col("canonical").isNotNull(), F.row_number().over(once)))
    how = F.when(F.col("r") == 1, F.element_at(F.array(F.lit("override"), F.lit("exact"), F.lit("alias")), F.col("rank") + 1)).otherwise("extra")
    named = ranked.select("file", "table_name", "column", F.when(F.col("r") == 1, F.col("canonical")).otherwise(F.coalesce(F.nullif("folded", F.lit("")), F.lit("column"))).alias("canonical"), how.alias("how"))
    taken = F.row_number().over(W.partitionBy("file", "canonical").orderBy(F.col("how") == "extra", "column"))
    return named.withColumn("_t", taken).withColumn("canonical", F.when(F.col("_t") > 1, F.concat_ws("__", "canonical", "_t")).otherwise(F.col("canonical"))).drop("_t")


def missing_required(mapped: DataFrame, spark: SparkSession) -> DataFrame:
    """(file, table_name, canonical) for required columns that a file doesn't have."""
    need = spark.createDataFrame([(c.name, r) for c in CONTRACTS.values() for r in c.required], "table_name string, canonical string")
    wanted = mapped.select("file", "table_name").distinct().join(F.broadcast(need), "table_name")
    return wanted.join(mapped.select("file", "canonical"), ["file", "canonical"], "left_anti")


def fuzzy_suggestions(mapped: DataFrame, spark: SparkSession, least: float = 0.8) -> DataFrame:
    """Unmapped headers and the canonical names they resemble: for review, never applied."""
    names = spark.createDataFrame([(c.name, n) for c in CONTRACTS.values() for n in c.columns], "table_name string, name string")
    near = mapped.where("how = 'extra'").join(F.broadcast(names), "table_name")
    score = 1 - F.levenshtein("canonical", "name") / F.greatest(F.length("canonical"), F.length("name"))
    return near.withColumn("score", score).where(F.col("score") >= least).select("file", "table_name", "column", F.col("name").alias("suggested"), "score")


def _order_values() -> tuple[Column, Column]:
    return parse_quantity(F.col("quantity")), to_finite(F.col("paid_amount"))


def mark_orders(raw: DataFrame) -> DataFrame:
    """Order lines with an invalid_reason, null where there is none: ids are required, quantity is whole and positive, amount finite and not negative.

    paid_time, where the table has it, may be missing, but what is there must be a date and time.
    """
    quantity, amount = _order_values()
    reason = (
        F.when(is_missing(F.col("order_id")), "order_id: missing").when(is_missing(F.col("sku_id")), "sku_id: missing")
        .when(F.coalesce(quantity, F.lit(0)) <= 0, "quantity: not a whole positive number").when(F.coalesce(amount, F.lit(-1.0)) < 0, "paid_amount: not a finite amount of 0 or more")
    )
    if "paid_time" in raw.columns:
        unread = ~is_missing(F.col("paid_time")) & parse_timestamp(F.col("paid_time")).isNull()
        reason = F.coalesce(reason, F.when(unread, "paid_time: not a date and time"))
    return raw.withColumn("invalid_reason", reason)


def validate_orders(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Order lines as (good, bad), by mark_orders; strict: the first bad one raises an error."""
    marked = mark_orders(raw)
    if strict:
        marked = marked.withColumn("invalid_reason", F.when(F.col("invalid_reason").isNotNull(), F.raise_error(F.col("invalid_reason"))).otherwise(F.col("invalid_reason")))
    quantity, amount = _order_values()
    values = {"order_id": optional_text(F.col("order_id")), "sku_id": optional_text(F.col("sku_id")), "quantity": quantity.try_cast("int"), "paid_amount": amount}
    return marked.where("invalid_reason IS NULL").withColumns(values).drop("invalid_reason"), marked.where("invalid_reason IS NOT NULL")


def tagged(frames: list[DataFrame]) -> DataFrame:
    """Files' rows together with their file and row order; columns that a file lacks are null."""
    each = [f.withColumn("_file", F.lit(i)) if "_row" in f.columns else f.withColumns({"_file": F.lit(i), "_row": F.monotonically_increasing_id()}) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def _values(rows: DataFrame, grain: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in (*grain, "_file", "_row")]


def grain_merge(rows: DataFrame, grain: list[str]) -> DataFrame:
    """One row for each key: of each column the first value that isn't null, in file and row order."""
    order = F.struct("_file", "_row")
    return rows.groupBy(*grain).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in _values(rows, grain)))


def merge_conflicts(rows: DataFrame, grain: list[str], tolerance: float = CONFLICT) -> DataFrame:
    """(grain, column, value_a, value_b, file_a, file_b): values of two files that disagree. A file's last row for a key counts.

    Both sides are as large as the table, however small its files are, so that neither may be sent to the driver.
    """
    names = _values(rows, grain)
    last = rows.groupBy(*grain, "_file").agg(F.max_by(F.struct(*names), "_row").alias("v")).select(*grain, "_file", "v.*")
    long = last.select(*grain, "_file", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names)))).where("value IS NOT NULL")
    a, b = long.withColumnsRenamed({"value": "value_a", "_file": "file_a"}), long.withColumnsRenamed({"value": "value_b", "_file": "file_b"})
    x, y = F.col("value_a").try_cast("double"), F.col("value_b").try_cast("double")
    both = is_finite(x) & is_finite(y)
    gap = F.abs(x - y) > tolerance * F.greatest(F.abs(x), F.abs(y))
    return a.hint("merge").join(b, [*grain, "column"]).where("file_a < file_b").where(F.when(both, gap).otherwise(F.col("value_a") != F.col("value_b")))


def build_statistics(rows: DataFrame, grain: list[str]) -> DataFrame:
    """input_rows, exact duplicates, accepted and merged rows."""
    plain = [c for c in rows.columns if c not in ("_file", "_row")]
    by_value = rows.groupBy(*plain).agg(F.count("*").alias("n"))
    keys = by_value.groupBy(*grain).agg(F.sum("n").alias("n"), F.count("*").alias("d")) if grain else by_value.withColumn("d", F.lit(1))
    merged = F.count("*") if grain else F.sum("n")
    return keys.agg(F.sum("n").alias("input_rows"), (F.sum("n") - F.sum("d")).alias("duplicate_rows"), F.sum("d").alias("accepted_rows"), merged.alias("merged_rows"))


def assess_mappings(mapped: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """mapped with the outcome of each mapping against an approved catalog (table_name, header, canonical, approved, metric_id).

    The tests' order counts: an operator's word, a header that the catalog gives another meaning, an approved or a
    pending entry for just this mapping, no catalog at all, no entry. accepted: whether the mapping may be used.
    """
    if catalog is None:
        outcome = F.when(F.col("how") == "override", "operator_confirmed").otherwise("catalog_unavailable")
        return mapped.withColumns({"outcome": outcome, "accepted": F.lit(True), "metric_ids": F.array().cast("array<long>")})
    entries = catalog.select("table_name", fold_name(F.col("header")).alias("_h"), F.col("canonical").alias("_to"), "approved", F.col("metric_id").cast("long").alias("_m"))
    hits = mapped.withColumn("_h", fold_name(F.col("column"))).join(entries, ["table_name", "_h"], "left")
    same, other = F.col("_to") == F.col("canonical"), F.col("_to") != F.col("canonical")
    found = hits.groupBy(*mapped.columns).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("_same", same), ("_ok", same & F.col("approved")), ("_other", other))), F.sort_array(F.collect_set("_m")).alias("metric_ids"))
    outcome = (
        F.when(F.col("how") == "override", "operator_confirmed").when(F.col("_other") & ~F.col("_same"), "conflict").when(F.col("how") == "fuzzy", "review_required")
        .when(F.col("_ok"), "verified").when(F.col("_same"), "reference_only").otherwise("no_platform_reference")
    )
    return found.withColumn("outcome", outcome).withColumn("accepted", ~F.col("outcome").isin("conflict", "review_required")).drop("_same", "_ok", "_other")
