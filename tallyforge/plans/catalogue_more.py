"""Registered queries on refund states, link joins, paid provenance, intent, evidence and seed themes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyforge.functions import statistics as S
from tallyforge.operators import bridge, distribution, evidence, paid, series, structure, text
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import TREND, TREND_DOUBLES, TREND_SELECT, daily, lines, monthly, perf, query
from tallyforge.sources import bindings as B
from tallyforge.sources import harmonise as H
from tallyforge.sources.build import build_tables
from tallyforge.sources.staging import shared_dir

EV, NF, OL, SP = T.with_(T.EVENTS), T.with_(T.EVENTS, T.FUNNEL), T.with_(T.ORDER_LINES), T.with_(T.ORDER_LINES, T.SKU_PERF)
_STATES = {2: " Refunded ", 3: "部分退款", 4: "paid", 5: "CANCELLED", 6: "closed"}


@query(
    "refund_status_sales",
    f"SELECT shop_id, sku_id, sum(quantity) AS units, count(DISTINCT order_id) AS order_count FROM (SELECT *, CASE line {' '.join(f'WHEN {k} THEN {v!r}' for k, v in _STATES.items())} END AS status FROM ol) WHERE status IS NULL OR lower(trim(status)) NOT IN ({', '.join(map(repr, H.REFUNDED))}) GROUP BY ALL",
    "units", OL,
)
def _(spark, d):
    status = F.lit(None).cast("string")
    for k, v in _STATES.items():
        status = F.when(F.col("line") == k, v).otherwise(status)
    return lines(spark, d).where(H.counts_as_sale(status)).groupBy("shop_id", "sku_id").agg(F.sum("quantity").alias("units"), F.countDistinct("order_id").alias("order_count"))


@query("linked_note_rows", "SELECT k, sku_id, views, clicks, p_name AS sku_name FROM (SELECT DISTINCT sku_id % 100 AS k, sku_id FROM ol WHERE priority = '1-URGENT') JOIN nf USING (k) LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = CAST(sku_id AS VARCHAR)", "", T.with_(T.ORDER_LINES, T.EVENTS, T.FUNNEL))
def _(spark, d):
    links = B.anchors(spark, d).select((F.col("sku_id") % 100).alias("k"), "sku_id").distinct()
    names = B.products(spark, d).select(F.col("sku_id").cast("string").alias("sku_id"), "sku_name")
    return structure.linked_rows(links, B.note_funnel(spark, d).select("k", "views", "clicks"), names, "k", "sku_id")


@query("wide_notes", "SELECT k, CAST(views AS DOUBLE) AS reads_optional, CAST(clicks AS DOUBLE) AS clicks_optional, CAST(NULL AS DOUBLE) AS likes_optional, CAST(NULL AS VARCHAR) AS title_optional FROM nf", "", NF)
def _(spark, d):
    notes = B.note_funnel(spark, d).withColumnRenamed("views", "reads")
    return structure.wide(notes, ["k"], {"reads": "double", "clicks": "double", "likes": "double", "title": "string"}, "_optional")


REPORTED = "CASE supplier_id % 3 WHEN 0 THEN quantity / 10 END AS roas_reported_row, CASE WHEN supplier_id % 3 = 1 OR supplier_id % 6 = 0 THEN quantity / 20 END AS roi_reported_row, CASE WHEN supplier_id % 4 <> 0 THEN paid_amount END AS known_gmv"


@query(
    "roas_sources",
    f"""SELECT supplier_id, spend, gmv, roas_calc, roas_reported, coalesce(roas_calc, roas_reported) AS roas_effective, CASE WHEN roas_calc IS NOT NULL THEN 'calculated_gmv' WHEN n_roas > 0 AND n_roi > 0 THEN 'reported_mixed_roas_roi' WHEN n_roas > 0 THEN 'reported_roas' WHEN n_roi > 0 THEN 'reported_roi' END AS roas_source, roas_calc - roas_reported AS roas_gap
    FROM (SELECT supplier_id, sum(spend) AS spend, sum(known_gmv) AS gmv, CASE WHEN sum(spend) > 0 THEN sum(known_gmv) / sum(spend) END AS roas_calc, count(roas_reported_row) AS n_roas, count(roi_reported_row) AS n_roi,
    coalesce(sum(CASE WHEN r IS NOT NULL AND spend > 0 THEN r * spend END) / nullif(sum(CASE WHEN r IS NOT NULL AND spend > 0 THEN spend END), 0), avg(r)) AS roas_reported FROM (SELECT *, coalesce(roas_reported_row, roi_reported_row) AS r FROM (SELECT *, {REPORTED} FROM ol)) GROUP BY supplier_id) ORDER BY roas_effective DESC NULLS LAST, supplier_id LIMIT 20""",
    "spend gmv roas_calc roas_reported roas_effective roas_gap", OL,
)
def _(spark, d):
    s, q = F.col("supplier_id"), F.col("quantity")
    rows = lines(spark, d).select("supplier_id", "spend", F.when(s % 4 != 0, F.col("paid_amount")).alias("gmv"), F.when(s % 3 == 0, q / 10).alias("roas"), F.when((s % 3 == 1) | (s % 6 == 0), q / 20).alias("roi"))
    return paid.roas_sources(rows, ["supplier_id"]).orderBy(F.desc_nulls_last("roas_effective"), "supplier_id").limit(20)


@query("paired_sums", "SELECT day, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a END) AS a, sum(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END) AS b, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS pairs FROM (SELECT day, CASE WHEN event_type <> 'error' THEN value END AS a, CASE WHEN event_type <> 'view' THEN value * 2 END AS b FROM ev) GROUP BY day", "a b", EV)
def _(spark, d):
    rows = B.traffic(spark, d).select("day", F.when(F.col("event_type") != "error", F.col("value")).alias("a"), F.when(F.col("event_type") != "view", F.col("value") * 2).alias("b"))
    return structure.paired_sums(rows, ["day"], "a", "b")


@query("store_name", "SELECT name, priority, n FROM (SELECT c_mktsegment AS name, 1 AS priority, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT n_name, 2, count(*) FROM nation GROUP BY ALL) WHERE trim(name) <> '' AND lower(trim(name)) NOT IN ('building', 'total') ORDER BY priority, n DESC, name LIMIT 1")
def _(spark, d):
    names = B.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(1).alias("priority")).unionAll(B.table(spark, d, "nation").select("n_name", F.lit(2)))
    return structure.store_name(names, ("building", "total"))


@query("sku_intent", "SELECT k, wishlist_users, cart_users, paid_buyers, cart_users / nullif(wishlist_users, 0) AS wishlist_to_cart, paid_buyers / nullif(cart_users, 0) AS cart_to_pay FROM (SELECT k, count(DISTINCT user_id) FILTER (event_type = 'view') AS wishlist_users, count(DISTINCT user_id) FILTER (event_type = 'click') AS cart_users, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS paid_buyers FROM ev GROUP BY k)", "wishlist_to_cart cart_to_pay", EV)
def _(spark, d):
    users = lambda e: F.countDistinct(F.when(F.col("event_type") == e, F.col("user_id")))
    rows = B.traffic(spark, d).groupBy("k").agg(users("view").alias("wishlist_users"), users("click").alias("cart_users"), users("purchase").alias("paid_buyers"))
    return structure.intent_funnel(rows, ["k"])


@query("terms_class_first", "SELECT k, views, orders, CASE WHEN views > 0 THEN orders / views END AS rate, row_number() OVER (ORDER BY views < 30, CASE WHEN views > 0 THEN orders / views END DESC NULLS LAST, k) AS place FROM nf ORDER BY place LIMIT 20", "rate", NF)
def _(spark, d):
    return structure.class_first(B.note_funnel(spark, d).select("k", "views", "orders"), "k", "views", "orders", 20)


@query("shared_skus", "SELECT sku_id FROM ol WHERE priority = '1-URGENT' INTERSECT SELECT sku_id FROM ol WHERE refunded", "", OL)
def _(spark, d):
    return B.anchors(spark, d).select("sku_id").intersect(lines(spark, d).where("refunded").select("sku_id"))


GRADES = f"""SELECT category_l1, n, CASE WHEN n <= 0 THEN 'not_judgable' WHEN n >= 30 AND n % 2 = 0 AND n % 3 = 0 THEN 'strong' WHEN n >= 10 AND n % 2 = 0 AND n % 3 <= 1 THEN 'medium' ELSE 'weak' END AS evidence,
 CASE WHEN n <= 0 THEN 'not_applicable' WHEN n >= 100 AND hi - lo <= 0.10 THEN 'high' WHEN n >= 30 AND hi - lo <= 0.20 THEN 'medium' ELSE 'low' END AS reliable, CAST(n * 0.05 AS DOUBLE) AS expected_false FROM (SELECT *, {T.wilson('k', 'n', True)} AS lo, {T.wilson('k', 'n', False)} AS hi FROM (SELECT category_l1, CAST(sum(refund_orders) AS BIGINT) AS k, CAST(sum(paid_orders) AS BIGINT) AS n FROM spp GROUP BY ALL))"""


@query("evidence_grades", f"SELECT *, CASE WHEN evidence = 'not_judgable' THEN evidence ELSE reliable END AS reader, CASE WHEN n % 5 = 0 THEN 'weak' WHEN evidence = 'strong' OR reliable = 'high' THEN 'strong' WHEN reliable = 'medium' THEN 'medium' ELSE 'weak' END AS tag FROM ({GRADES})", "expected_false", SP)
def _(spark, d):
    rows = perf(spark, d).groupBy("category_l1").agg(F.sum("refund_orders").alias("k"), F.sum("paid_orders").alias("n"))
    n = F.col("n")
    low, high = S.wilson(F.col("k"), n)
    graded = rows.select("category_l1", "n", evidence.evidence_grade(n, n % 2 == 0, n % 3).alias("evidence"), evidence.reliability(n, low, high).alias("reliable"), evidence.expected_false_positives(n).alias("expected_false"))
    claim = F.when(n % 5 == 0, "mechanism").otherwise("description")
    return graded.withColumns({"reader": evidence.reader_confidence(F.col("evidence"), F.col("reliable")), "tag": evidence.confidence_tag(F.col("evidence"), F.col("reliable"), claim)})


@query("bridge_gate", "SELECT shop_id, period_month, buyer_days, buyers, CASE WHEN buyer_days > buyers THEN 'refused' ELSE 'allowed' END AS daily_sums FROM (SELECT shop_id, strftime(day, '%Y-%m') AS period_month, CAST(sum(paid_buyers) AS BIGINT) AS buyer_days FROM sd GROUP BY ALL) JOIN (SELECT shop_id, strftime(day, '%Y-%m') AS period_month, count(DISTINCT buyer_id) AS buyers FROM ol GROUP BY ALL) USING (shop_id, period_month)", "", T.with_(T.ORDER_LINES, T.SHOP_DAY))
def _(spark, d):
    month = F.date_format("day", "yyyy-MM").alias("period_month")
    people = lines(spark, d).groupBy("shop_id", month).agg(F.countDistinct("buyer_id").alias("buyers"))
    return bridge.gate(daily(spark, d).groupBy("shop_id", month).agg(F.sum("paid_buyers").alias("buyer_days")).join(people, ["shop_id", "period_month"]))


SEEDS = {"delivery": ("er", "in"), "price": ("pri", "cost"), "none": ("qqqq",)}


@query(
    "seed_themes",
    "SELECT term, c AS \"count\", doc_count, doc_count / n AS coverage, c * doc_count / n AS score FROM (SELECT term, CAST(sum(hits) AS BIGINT) AS c, count(*) AS doc_count FROM ("
    + " UNION ALL ".join(f"SELECT '{g}' AS term, {' + '.join(f'len(regexp_extract_all(text, {w!r}))' for w in ws)} AS hits FROM conversations WHERE role = 'user'" for g, ws in SEEDS.items())
    + ") WHERE hits > 0 GROUP BY term), (SELECT count(*) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '')",
    "coverage score",
)
def _(spark, d):
    return text.seed_themes(B.comments(spark, d), "text", SEEDS)


@query("group_polarity", "SELECT g AS demand_group, coalesce(avg(CASE WHEN p <> 0 THEN p END), 0.0) AS mean_polarity FROM (SELECT CASE WHEN regexp_matches(lower(text), 'size|big|small|large|fit') THEN 'capacity' WHEN regexp_matches(lower(text), 'price|cost|cheap|much|pay') THEN 'price' WHEN regexp_matches(lower(text), 'link|where|buy|shop') THEN 'link' WHEN regexp_matches(lower(text), 'gift|present|birthday') THEN 'gift' ELSE 'other' END AS g, CASE WHEN a + b > 0 THEN (a - b) / (a + b) ELSE 0.0 END AS p FROM (SELECT text, len(regexp_extract_all(text, 'the')) AS a, len(regexp_extract_all(text, 'er')) AS b FROM conversations WHERE role = 'user')) GROUP BY g", "mean_polarity")
def _(spark, d):
    rows = B.comments(spark, d).withColumn("demand_group", text.demand_group(F.col("text")))
    return text.mean_polarity(rows, ["demand_group"], F.col("text"), ("the",), ("er",))


@query("histogram_bins", "SELECT b.bin, CAST(1 + 7 * b.bin AS DOUBLE) AS low, CAST(CASE WHEN b.bin < 6 THEN 8 + 7 * b.bin END AS DOUBLE) AS high, count(p_size) AS \"count\", count(p_size) / sum(count(p_size)) OVER () AS share FROM (SELECT unnest(range(7)) AS bin) b LEFT JOIN part ON least((p_size - 1) // 7, 6) = b.bin GROUP BY b.bin", "low high share")
def _(spark, d):
    return distribution.histogram(B.products(spark, d), "size", 7)


RUNNING = "sm AS (SELECT shop_id, period_month, sum(gmv) OVER (PARTITION BY shop_id ORDER BY period_month) AS gmv FROM (SELECT shop_id, strftime(day, '%Y-%m') AS period_month, sum(gmv) AS gmv FROM sd GROUP BY ALL))"


@query("trend_of_totals", f"SELECT *, 7::BIGINT AS horizon, greatest(fitted_last + slope * 7, 0.0) AS projected_value FROM ({TREND_SELECT}) WHERE n >= 4 AND significant", TREND_DOUBLES + " projected_value", T.with_(T.ORDER_LINES, T.SHOP_DAY, RUNNING, TREND), digits=1)
def _(spark, d):
    return series.trend_projection(series.trend_summary(series.running_total(monthly(spark, d), ["shop_id"], "period_month", "gmv"), ["shop_id"], "period_month", "gmv"), 7, True)


@query("gated_direction", f"SELECT shop_id, CASE WHEN NOT significant THEN 'unclear' ELSE direction END AS direction FROM ({TREND_SELECT})", "", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH, TREND))
def _(spark, d):
    return series.gated_direction(series.trend_summary(monthly(spark, d), ["shop_id"], "period_month", "gmv")).select("shop_id", "direction")


@query("built_skus", "SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_name AS sku_name, p_retailprice AS price, CAST(p_size AS DOUBLE) AS inventory_optional, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand FROM part", "price")
def _(spark, d):
    """The part table as two exports with different headers, built back into one table."""
    folder, part = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}", B.table(spark, d, "part")
    half = lambda n: part.where(F.col("p_partkey") % 2 == n)
    half(0).select(F.col("p_partkey").alias("sku_id"), F.col("p_name").alias("sku_name"), F.col("p_retailprice").alias("unit_price"), F.col("p_size").alias("inventory_optional"), F.col("p_brand").alias("Brand")).write.option("header", True).csv(f"{folder}/in/a")
    half(1).select(F.col("p_name").alias("SKU name"), F.col("p_partkey").alias("SKU_ID"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("Inventory-optional")).write.option("header", True).csv(f"{folder}/in/b")
    build_tables(spark, f"{folder}/in", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/skus").select("sku_id", "sku_name", "price", "inventory_optional", "brand")


def exports(spark, d) -> str:  # noqa: ANN001
    """A folder with comments that have line breaks, order lines (one in seven twice, some with bad cells) and a copy of the comments."""
    folder = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}"
    say = F.concat(F.col("role"), F.lit("\n\"says\", "), F.col("text"))
    talk = B.table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), F.lit("2024-01-02").alias("comment_time"), say.alias("comment_text"))
    for part in ("talk", "copy"):
        talk.coalesce(1).orderBy("note_id").write.option("header", True).option("escape", '"').csv(f"{folder}/in/{part}")
    line = B.table(spark, d, "lineitem")
    quantity = F.when(F.col("l_orderkey") % 10 == 0, F.lit("1.5")).when(F.col("l_orderkey") % 11 == 0, F.lit("two")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = line.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("paid_time"), quantity.alias("quantity"),
        F.col("l_extendedprice").alias("paid_amount"), F.when(F.col("l_orderkey") % 7 == 0, 2).otherwise(1).alias("times"),
    )
    rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times").write.option("header", True).csv(f"{folder}/in/lines")
    return folder


@query(
    "built_comments",
    "SELECT conv_id || '-' || turn AS note_id, role || chr(10) || '\"says\", ' || text AS comment_text FROM conversations",
)
def _(spark, d):
    folder = exports(spark, d)
    build_tables(spark, f"{folder}/in", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out/comments").select("note_id", "comment_text")


_EXPORTED = "ex AS (SELECT *, l_orderkey % 10 = 0 OR l_orderkey % 11 = 0 AS bad, CASE WHEN l_orderkey % 7 = 0 THEN 2 ELSE 1 END AS times FROM lineitem)"


@query(
    "built_orders",
    """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id, CAST(sum(times) AS BIGINT) AS lines, CAST(sum(times * CAST(l_quantity AS INT)) AS BIGINT) AS quantity,
      sum(times * l_extendedprice) AS paid_amount FROM ex WHERE NOT bad GROUP BY ALL""",
    "paid_amount",
    T.with_(_EXPORTED),
)
def _(spark, d):
    folder = exports(spark, d)
    build_tables(spark, f"{folder}/in", f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out/orders")
    return rows.groupBy("order_id", "sku_id").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), F.sum("paid_amount").alias("paid_amount"))


@query(
    "build_manifest",
    """SELECT 'orders' AS table_name, 'classified' AS status, CAST(sum(times) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken, CAST(sum(times) FILTER (bad) AS BIGINT) AS invalid,
      CAST(sum(times) FILTER (NOT bad) AS BIGINT) AS merged_rows FROM ex UNION ALL SELECT 'comments', 'classified', count(*), 0, 0, count(*) FROM conversations
      UNION ALL SELECT 'comments', 'copy', NULL, NULL, NULL, NULL""",
    "",
    T.with_(_EXPORTED),
)
def _(spark, d):
    folder = exports(spark, d)
    found = build_tables(spark, f"{folder}/in", f"{folder}/out").where(F.col("file").rlike("\\.csv$"))
    sums = (F.sum(c).alias(c) for c in ("rows", "broken", "invalid"))
    return found.groupBy("table_name", "status").agg(*sums, F.max("merged_rows").alias("merged_rows"))
