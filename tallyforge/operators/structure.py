"""Structure of a shop: shares, matrices, funnels, interactions, opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.functions import statistics as S
from tallyforge.functions.cleaning import ratio
from tallyforge.operators.distribution import quantiles
from tallyforge.operators.ranks import with_group


def share_of(df: DataFrame, keys: list[str], group: list[str], values: list[str]) -> DataFrame:
    """Sums by group and each one's share of its keys' total."""
    s = df.groupBy(*keys, *group).agg(*(F.sum(v).alias(v) for v in values))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return s.withColumns({f"{v}_share": ratio(F.col(v), F.sum(v).over(by)) for v in values})


def group_effects(features: DataFrame, metrics: DataFrame, dimension: str, key: str, sums: list[str]) -> DataFrame:
    """Metrics by a feature: distinct (feature, key) pairs with each key's metrics, aggregated first so that nothing fans out."""
    per = metrics.groupBy(key).agg(*(F.max(c).alias(c) for c in sums))
    pairs = features.select(F.coalesce(F.nullif(F.trim(F.col(dimension).cast("string")), F.lit("")), F.lit("unknown")).alias(dimension), key).dropDuplicates()
    joined = pairs.join(per.withColumn("_m", F.col(key)), key, "left")
    return joined.groupBy(dimension).agg(F.countDistinct(key).alias("notes"), F.countDistinct("_m").alias("matched_notes"), *(F.sum(c).alias(c) for c in sums))


def interaction(features: DataFrame, metrics: DataFrame, dims: list[str], key: str, value: str) -> DataFrame:
    """Groups of two or three features: distinct keys and their mean value."""
    per = metrics.groupBy(key).agg(F.max(value).alias(value))
    return features.select(*dims, key).dropDuplicates().join(per, key, "left").groupBy(*dims).agg(F.countDistinct(key).alias("notes"), F.avg(value).alias(f"avg_{value}"))


def unpivot_groups(df: DataFrame, keys: list[str], groups: list[str], metrics: list[str], name: str = "carrier") -> DataFrame:
    """Columns <group>_<metric> as rows (keys, group, metrics); absent columns are null."""
    rows = [F.struct(F.lit(g).alias(name), *((F.col(f"{g}_{m}") if f"{g}_{m}" in df.columns else F.lit(None).cast("double")).alias(m) for m in metrics)) for g in groups]
    return df.select(*keys, F.inline(F.array(*rows)))


def unpivot_prefixes(df: DataFrame, keys: list[str], metrics: list[str], name: str = "carrier") -> DataFrame:
    """unpivot_groups for whatever prefixes the columns have: <prefix>_<metric> of any of the metrics; the longest metric's name counts."""
    found = set()
    for c in df.columns:
        ends = [m for m in metrics if c.endswith(f"_{m}")] if c not in keys else []
        if ends:
            found.add(c.removesuffix("_" + max(ends, key=len)))
    return unpivot_groups(df, keys, sorted(found), metrics, name)


def stage_rates(df: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """A row for each step of a funnel (stages are count columns): rate, Wilson bounds, and whether it is the weakest step with n of 30."""
    s = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in stages))
    steps = []
    for a, b in zip(stages, stages[1:], strict=False):
        lo, hi = S.wilson(F.col(b), F.col(a))
        steps.append(F.struct(F.lit(f"{a}_to_{b}").alias("funnel_stage"), F.col(a).cast("double").alias("denominator"), F.when(F.col(a) > 0, S.clamp(F.col(b), F.col(a)) / F.nullif(F.col(a).cast("double"), F.lit(0.0))).alias("rate"), lo.alias("ci_low"), hi.alias("ci_high")))
    rows = s.select(*keys, F.inline(F.array(*steps)))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    fit = F.when(S.enough(F.col("denominator")), F.col("rate"))
    return rows.withColumn("is_weakest", F.coalesce(F.row_number().over(by.orderBy(fit.asc_nulls_last(), "funnel_stage")) == 1, F.lit(False)) & fit.isNotNull())


def observed_or_derived(observed: Column, base: Column, rate: Column) -> tuple[Column, Column]:
    """A count and where it comes from: real, forward_derived (base * rate) or missing."""
    derived = base * rate
    return F.coalesce(observed, derived), F.when(observed.isNotNull(), "real").when(derived.isNotNull(), "forward_derived").otherwise("missing")


def complete_sum(c: Column) -> Column:
    """The sum, or null if any row lacks the value."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def term_classes(df: DataFrame, term: str, n: str, k: str) -> DataFrame:
    """Search terms against the pooled rate: opportunity, leak or average by Wilson bounds; small_sample under 30; not_judgable without n."""
    whole = df.agg((F.sum(k) / F.nullif(F.sum(n).cast("double"), F.lit(0.0))).alias("baseline"))
    lo, hi = S.wilson(F.col(k), F.col(n))
    rows = df.crossJoin(F.broadcast(whole)).withColumns({"rate": ratio(S.clamp(F.col(k), F.col(n)), F.col(n)), "wilson_low": lo, "wilson_high": hi})  # one row
    kind = F.when(F.col(n).isNull() | (F.col(n) <= 0), "not_judgable").when(F.col(n) < S.MIN_N, "small_sample").when(F.col("wilson_low") > F.col("baseline"), "opportunity").when(F.col("wilson_high") < F.col("baseline"), "leak").otherwise("average")
    return rows.select(term, n, k, "baseline", "rate", "wilson_low", "wilson_high", kind.alias("term_class"))


def widest_window(df: DataFrame, keys: list[str], cycle: str, rollup: str | None = None) -> DataFrame:
    """Rows of the widest nested window ('180 days' lies in '365 days') of each group; rollup rows are left out."""
    days = F.regexp_replace(cycle, r"\D", "").try_cast("int")
    rows = df if rollup is None else df.where(F.col(cycle) != rollup)
    return rows.withColumn("_d", days).withColumn("_m", F.max("_d").over(W.partitionBy(*keys))).where("_d = _m").drop("_d", "_m")


def opportunities(catalog: DataFrame, sales: DataFrame, key: str) -> DataFrame:
    """Catalog and sales keys together: sales per active day, stock cover and what to do."""
    both = catalog.join(sales, key, "full_outer")
    per = ratio(F.col("units"), F.col("active_days"))
    cover = ratio(F.col("inventory").cast("double"), per)
    kind = F.when(F.col("units").isNull() | (F.col("units") <= 0), "needs_sales").when(F.col("inventory") <= 0, "out_of_stock").when(cover <= 7, "low_inventory").otherwise("response_present")
    return both.select(key, "units", "gmv", "active_days", per.alias("units_per_active_day"), ratio(F.col("gmv"), F.col("active_days")).alias("gmv_per_active_day"), "inventory", cover.alias("inventory_cover_active_days"), kind.alias("opportunity_type"))


def round_robin_plan(skus: DataFrame, angles: DataFrame, start: str, days: int = 7, slots: int = 5) -> DataFrame:
    """A week of slots with SKUs and angles in turn; skus(sku_id, pos) and angles(angle, pos) are short ranked lists, pos from 0."""
    n_sku, n_angle = skus.agg(F.count("*").alias("n_sku")), angles.agg(F.count("*").alias("n_angle"))
    grid = skus.sparkSession.range(days * slots).select(F.floor(F.col("id") / slots).alias("day_index"), (F.col("id") % slots).alias("slot_index"), F.col("id").alias("slot"))
    sized = grid.crossJoin(F.broadcast(n_sku)).crossJoin(F.broadcast(n_angle))  # one row each
    plan = sized.join(skus.withColumnRenamed("pos", "_s"), F.col("slot") % F.col("n_sku") == F.col("_s")).join(angles.withColumnRenamed("pos", "_a"), (F.col("day_index") + F.col("slot_index")) % F.col("n_angle") == F.col("_a"))
    return plan.select(F.date_add(F.lit(start).cast("date"), F.col("day_index").cast("int")).alias("day"), "day_index", "slot_index", "sku_id", "angle")


def reshoot_score(df: DataFrame, shown: int = 10) -> DataFrame:
    """Notes (k, views, reads, collects, orders) worth doing again: collect rate shrunk by reads / (reads + 50), times the gap to the most read."""
    top = df.agg(F.max("reads").alias("_top"))
    weight = F.col("reads") / (F.col("reads") + 50.0)
    rows = df.crossJoin(F.broadcast(top)).withColumns({"collect_rate": ratio(F.col("collects").cast("double"), F.col("reads")), "confidence_weight": weight})  # one row
    rows = rows.withColumns({"conservative_collect_rate": F.col("collect_rate") * F.col("confidence_weight"), "read_gap_to_max": 1 - ratio(F.col("reads").cast("double"), F.col("_top"))})
    score = F.col("conservative_collect_rate") * (1 + F.col("read_gap_to_max"))
    return rows.withColumn("opportunity_score", score).orderBy(F.desc_nulls_last("opportunity_score"), F.desc("collects"), F.asc("k")).limit(shown).drop("_top")


def modal_value(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The most frequent (column, value) of each key; ties go to the earlier column, then the smaller value."""
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns))))).where("value IS NOT NULL")
    counts = long.groupBy(*keys, "place", "feature", "value").agg(F.count("*").alias("n"))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return counts.withColumn("_r", F.row_number().over(by.orderBy(F.desc("n"), "place", "value"))).where("_r = 1").drop("_r", "place")


def composition(df: DataFrame, dimension: str, segment: str, n: str) -> DataFrame:
    """Share of each segment in its dimension, and whether it is the dimension's largest."""
    s = share_of(df, [dimension], [segment], [n])
    return s.withColumn("is_top", F.row_number().over(W.partitionBy(dimension).orderBy(F.desc(n), segment)) == 1)


def value_tags(df: DataFrame, keys: list[str], value: str, high: float = 1.5, low: float = 0.5) -> DataFrame:
    """Values against their group's median: high from 1.5 times, low to half of it."""
    middle = quantiles(df, keys, value, (0.5,)).select(*keys, F.col("quantiles")[0].alias("_m"))
    return with_group(df, middle, keys).withColumn("tag", F.when(F.col(value) >= high * F.col("_m"), "high").when(F.col(value) <= low * F.col("_m"), "low").otherwise("normal")).drop("_m")


def curated(df: DataFrame, by: str, tie: str, shown: int, highlight: Column) -> DataFrame:
    """The first rows with numbers before text before null, and a highlight flag."""
    number = F.col(by).try_cast("double")
    return df.orderBy(number.asc_nulls_last(), F.col(by).asc_nulls_last(), tie).limit(shown).withColumn("highlight", F.coalesce(highlight, F.lit(False)))


def context_sets(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Of each key the sorted distinct values of some columns with few values."""
    return df.groupBy(key).agg(*(F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in columns))


def linked_rows(links: DataFrame, notes: DataFrame, names: DataFrame, note: str, sku: str) -> DataFrame:
    """A row for each link: its note's columns, once for each SKU, and the SKU's name. Names may be keyed by text."""
    return links.join(notes, note).withColumn("_sku", F.col(sku).cast("string")).join(names.withColumnRenamed(sku, "_sku"), "_sku", "left").drop("_sku")


def wide(df: DataFrame, keys: list[str], columns: dict[str, str], suffix: str = "") -> DataFrame:
    """All the named columns with their types; those that df lacks are null."""
    return df.select(*keys, *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(f"{c}{suffix}") for c, t in columns.items()))


def paired_sums(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Sums of two columns over the rows that have both, and how many these are."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*keys).agg(F.sum(F.when(both, F.col(a))).alias(a), F.sum(F.when(both, F.col(b))).alias(b), F.count_if(both).alias("pairs"))


def store_name(names: DataFrame, summaries: tuple[str, ...]) -> DataFrame:
    """The most frequent of (name, priority) in the source of least priority that has one; names of summary rows don't count."""
    text = F.trim(F.col("name").cast("string"))
    kept = names.select(text.alias("name"), "priority").where((F.col("name") != "") & ~F.lower("name").isin(*summaries))
    return kept.groupBy("name", "priority").agg(F.count("*").alias("n")).orderBy("priority", F.desc("n"), "name").limit(1)


def intent_funnel(df: DataFrame, keys: list[str]) -> DataFrame:
    """Steps from wishlist to cart to payment; rows without any of the three counts go."""
    steps = ("wishlist_users", "cart_users", "paid_buyers")
    rows = df.where(F.coalesce(*steps).isNotNull())
    return rows.select(*keys, *steps, ratio(F.col("cart_users"), F.col("wishlist_users")).alias("wishlist_to_cart"), ratio(F.col("paid_buyers"), F.col("cart_users")).alias("cart_to_pay"))


def class_first(df: DataFrame, key: str, n: str, k: str, shown: int) -> DataFrame:
    """The first rows by rate, those with too small a sample after all others."""
    rate = ratio(F.col(k), F.col(n))
    top = df.withColumn("rate", rate).orderBy(F.col(n) < S.MIN_N, F.desc_nulls_last("rate"), key).limit(shown)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.col(n) < S.MIN_N, F.desc_nulls_last("rate"), key)).cast("long"))  # the shown rows


#: Reads below which a note needs more data, and the weights of what its readers did.
CONFIDENT_READS, INTENT, ORDERS = 50, 0.5, 0.5


def reshoot_candidates(notes: DataFrame, shown: int = 10) -> DataFrame:
    """Ranked notes (note, reads, collects, clicks, orders, gmv, refund_amount): shrunk collect rate, gap to the most read, intent, less refunds.

    Notes with enough reads come first; ties go by score, shrunk rate, rate, reads and note.
    """
    c = F.col
    top = notes.agg(F.max("reads").cast("double").alias("_top"))
    rows = notes.crossJoin(F.broadcast(top))  # one row
    rate = F.coalesce(ratio(c("collects"), c("reads")), F.lit(0.0))
    rows = rows.withColumns({
        "collect_rate": rate, "conservative_collect_rate": c("reads") / (c("reads") + F.lit(float(CONFIDENT_READS))) * rate,
        "read_gap_to_max": 1 - ratio(c("reads"), c("_top")), "click_rate": ratio(c("clicks"), c("reads")), "order_rate": ratio(c("orders"), c("clicks")),
        "refund_penalty": F.when(c("gmv") > 0, F.least(F.greatest(c("refund_amount") / c("gmv"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0),
        "needs_more_data": c("reads") < CONFIDENT_READS,
    })
    most = lambda x: F.least(F.coalesce(c(x), F.lit(0.0)), F.lit(1.0))
    bonus = 1 + INTENT * most("click_rate") + ORDERS * most("order_rate")
    score = c("conservative_collect_rate") * (1 + c("read_gap_to_max")) * bonus * (1 - c("refund_penalty"))
    order = [c("needs_more_data"), *(F.desc(x) for x in ("opportunity_score", "conservative_collect_rate", "collect_rate", "reads")), c("note")]
    best = rows.withColumn("opportunity_score", score).orderBy(*order).limit(shown)
    kept = ("note", "reads", "collects", "collect_rate", "conservative_collect_rate", "read_gap_to_max", "click_rate", "order_rate", "refund_penalty", "needs_more_data", "opportunity_score")
    return best.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"), *kept)  # the shown rows


def leaks(df: DataFrame, term: str, views: str, clicks: str, orders: str) -> DataFrame:
    """Terms whose orders per view are below all terms', by the step that is below its own baseline: the click first, then the order."""
    n = lambda x: F.sum(x).cast("double")
    whole = df.agg(ratio(n(clicks), n(views)).alias("_click"), ratio(n(orders), n(clicks)).alias("_order"), ratio(n(orders), n(views)).alias("_all"))
    rows = df.crossJoin(F.broadcast(whole)).withColumns({"click_rate": ratio(F.col(clicks), F.col(views)), "order_rate": ratio(F.col(orders), F.col(clicks))})  # one row
    kind = F.when(F.col("click_rate") < F.col("_click"), "click_leak").when(F.col("order_rate") < F.col("_order"), "conversion_leak").otherwise("leak")
    return rows.where((F.col(views) > 0) & (F.col(orders) / F.col(views) < F.col("_all"))).select(term, views, clicks, orders, "click_rate", "order_rate", kind.alias("leak_type"))
