"""Registered queries of the diagnosis tasks that the other modules don't cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.functions import statistics as S
from tallyforge.operators import distribution, paid, series, structure
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import lines, perf, query
from tallyforge.plans.catalogue_structure import FILES, two_files
from tallyforge.sources import bindings as B
from tallyforge.sources import harmonise as H

EV, NF, OL, SP = T.with_(T.EVENTS), T.with_(T.EVENTS, T.FUNNEL), T.with_(T.ORDER_LINES), T.with_(T.ORDER_LINES, T.SKU_PERF)


@query("curated_view", "SELECT sku_id, v, coalesce(v = 'large', false) AS highlight FROM (SELECT p_partkey AS sku_id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN lower(p_type) END AS v FROM part) ORDER BY TRY_CAST(v AS DOUBLE) NULLS LAST, v NULLS LAST, sku_id LIMIT 800")
def _(spark, d):
    p = B.products(spark, d)
    mixed = F.when(F.col("sku_id") % 3 == 0, F.col("size").cast("string")).when(F.col("sku_id") % 3 == 1, F.lower("category_l1"))
    return structure.curated(p.select("sku_id", mixed.alias("v")), "v", "sku_id", 800, F.col("v") == "large")


@query("inspection_summary", "SELECT f AS file, count(*) AS rows, count(DISTINCT sku_id) AS keys, (SELECT count(*) FROM (SELECT sku_id FROM a UNION SELECT sku_id FROM b)) AS merged_rows, (SELECT count(*) FROM a JOIN b USING (sku_id) WHERE abs(a.price - b.price) > 0.05 * greatest(abs(a.price), abs(b.price))) AS conflicts FROM (SELECT 0 AS f, sku_id FROM a UNION ALL SELECT 1, sku_id FROM b) GROUP BY f", "", T.with_(FILES))
def _(spark, d):
    rows = two_files(spark, d)
    merged = H.grain_merge(rows, ["sku_id"]).agg(F.count("*").alias("merged_rows"))
    bad = H.merge_conflicts(rows, ["sku_id"]).agg(F.count("*").alias("conflicts"))
    files = rows.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("rows"), F.countDistinct("sku_id").alias("keys"))
    return files.crossJoin(F.broadcast(merged)).crossJoin(F.broadcast(bad))  # one row each


@query("refund_trend", f"SELECT * EXCLUDE (b) FROM (SELECT *, lag(refund_rate) OVER w AS b, refund_rate - b AS delta, CASE WHEN b <> 0 THEN (refund_rate - b) / b END AS pct, {T.direction('coalesce(refund_rate - b, 0)')} AS direction FROM (SELECT carrier, strftime(day, '%Y-%m') AS period, count(DISTINCT CASE WHEN refunded THEN order_id END) / count(DISTINCT order_id) AS refund_rate FROM ol GROUP BY ALL) WINDOW w AS (PARTITION BY carrier ORDER BY period))", "refund_rate delta pct", OL)
def _(spark, d):
    rate = F.countDistinct(F.when(F.col("refunded"), F.col("order_id"))) / F.countDistinct("order_id")
    rows = lines(spark, d).groupBy("carrier", F.date_format("day", "yyyy-MM").alias("period")).agg(rate.alias("refund_rate"))
    return series.mom_change(rows, ["carrier"], "period", "refund_rate")


@query(
    "channel_conversion", f"SELECT shop_id, carrier, orders, buyers, buyers / orders AS conversion, gmv / buyers AS aov, {T.wilson('buyers', 'orders', True)} AS ci_low, {T.wilson('buyers', 'orders', False)} AS ci_high FROM (SELECT shop_id, carrier, count(DISTINCT order_id) AS orders, count(DISTINCT buyer_id) AS buyers, sum(paid_amount) AS gmv FROM ol GROUP BY ALL)",
    "conversion aov ci_low ci_high", OL,
)
def _(spark, d):
    s = lines(spark, d).groupBy("shop_id", "carrier").agg(F.countDistinct("order_id").alias("orders"), F.countDistinct("buyer_id").alias("buyers"), F.sum("paid_amount").alias("gmv"))
    lo, hi = S.wilson(F.col("buyers"), F.col("orders"))
    return s.select("shop_id", "carrier", "orders", "buyers", C.ratio(F.col("buyers"), F.col("orders")).alias("conversion"), C.ratio(F.col("gmv"), F.col("buyers")).alias("aov"), lo.alias("ci_low"), hi.alias("ci_high"))


@query("note_pareto", "SELECT k, gmv, row_number() OVER w AS rank, row_number() OVER w / count(*) OVER () AS cum_item_frac, gmv / sum(gmv) OVER () AS share, sum(gmv) OVER (ORDER BY gmv DESC, k ROWS UNBOUNDED PRECEDING) / sum(gmv) OVER () AS cum_share FROM nf WHERE gmv IS NOT NULL WINDOW w AS (ORDER BY gmv DESC, k)", "gmv cum_item_frac share cum_share", NF)
def _(spark, d):
    return distribution.pareto(B.note_funnel(spark, d), [], "k", "gmv")


@query("sku_net_value", "SELECT category_l2, count(*) AS sku_count, sum(gmv) AS gmv, sum(refund_amount) AS refund_amount_pay, sum(net_gmv) AS net_gmv_pay, sum(net_gmv) / sum(gmv) AS net_retention_rate, CASE WHEN count(DISTINCT category_l1) = 1 THEN max(category_l1) END AS only_l1 FROM spp GROUP BY category_l2", "gmv refund_amount_pay net_gmv_pay net_retention_rate", SP)
def _(spark, d):
    s = perf(spark, d).groupBy("category_l2").agg(F.count("*").alias("sku_count"), F.sum("gmv").alias("gmv"), F.sum("refund_amount").alias("refund_amount_pay"), F.sum("net_gmv").alias("net_gmv_pay"), F.when(F.countDistinct("category_l1") == 1, F.max("category_l1")).alias("only_l1"))
    return s.withColumn("net_retention_rate", C.ratio(F.col("net_gmv_pay"), F.col("gmv")))


@query("complete_sums", "SELECT user_id, CASE WHEN count(v) = count(*) THEN sum(v) END AS complete, sum(v) AS partial, count(v) AS known FROM (SELECT user_id, CASE WHEN event_id % 40 <> 0 THEN value END AS v FROM ev) GROUP BY user_id", "complete \"partial\"", EV)
def _(spark, d):
    v = F.when(F.col("event_id") % 40 != 0, F.col("value"))
    return B.traffic(spark, d).withColumn("v", v).groupBy("user_id").agg(structure.complete_sum(F.col("v")).alias("complete"), F.sum("v").alias("partial"), F.count("v").alias("known"))


@query("weighted_rate", "SELECT day, coalesce(sum(CASE WHEN w > 0 THEN r * w END) / nullif(sum(CASE WHEN w > 0 THEN w END), 0), avg(r)) AS rate, sum(orders / r) FILTER (r > 0) AS derived_base FROM (SELECT day, k, count(*) FILTER (event_type = 'view') AS w, count(*) FILTER (event_type = 'purchase') AS orders, count(*) FILTER (event_type = 'click') / count(*) AS r FROM ev GROUP BY day, k) GROUP BY day", "rate derived_base", EV)
def _(spark, d):
    n = lambda e: F.count_if(F.col("event_type") == e)
    rows = B.traffic(spark, d).groupBy("day", "k").agg(n("view").alias("w"), n("purchase").alias("orders"), (n("click") / F.count("*")).alias("r"))
    return rows.groupBy("day").agg(paid.weighted_average(F.col("r"), F.col("w")).alias("rate"), F.sum(C.ratio(F.col("orders"), F.col("r"))).alias("derived_base"))


@query("modal_feature", "SELECT category_l1, feature, value, n FROM (SELECT *, row_number() OVER (PARTITION BY category_l1 ORDER BY n DESC, place, value) AS r FROM (SELECT p_type AS category_l1, 0 AS place, 'category_l2' AS feature, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT p_type, 1, 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY ALL)) WHERE r = 1")
def _(spark, d):
    return structure.modal_value(B.products(spark, d), ["category_l1"], ["category_l2", "size"])


@query("audience_composition", "SELECT event_type, segment, users, users / sum(users) OVER (PARTITION BY event_type) AS users_share, row_number() OVER (PARTITION BY event_type ORDER BY users DESC, segment) = 1 AS is_top FROM (SELECT event_type, user_id % 5 AS segment, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL)", "users_share", EV)
def _(spark, d):
    rows = B.traffic(spark, d).groupBy("event_type", (F.col("user_id") % 5).alias("segment")).agg(F.countDistinct("user_id").alias("users"))
    return structure.composition(rows, "event_type", "segment", "users")


@query("aov_tags", "SELECT category_l1, tag, count(*) AS skus FROM (SELECT category_l1, CASE WHEN aov >= 1.5 * m THEN 'high' WHEN aov <= 0.5 * m THEN 'low' ELSE 'normal' END AS tag FROM spp JOIN (SELECT category_l1, quantile_cont(aov, 0.5) AS m FROM spp GROUP BY ALL) USING (category_l1)) GROUP BY ALL", "", SP)
def _(spark, d):
    return structure.value_tags(perf(spark, d), ["category_l1"], "aov").groupBy("category_l1", "tag").agg(F.count("*").alias("skus"))


@query("comment_context", "SELECT conv_id, list_sort(list(DISTINCT role)) AS roles, list_sort(list(DISTINCT turn)) AS turns FROM conversations GROUP BY conv_id")
def _(spark, d):
    return structure.context_sets(B.table(spark, d, "conversations"), "conv_id", ["role", "turn"])


@query("threshold_bars", f"SELECT bar, count(*) AS notes FROM (SELECT CASE WHEN views = 0 THEN 'not_judgable' WHEN clicks / views > b THEN 'above' WHEN clicks / views < b THEN 'below' ELSE 'at' END AS bar FROM (SELECT *, sum(clicks) OVER () / sum(views) OVER () AS b FROM nf)) GROUP BY bar", "", NF)
def _(spark, d):
    notes = B.note_funnel(spark, d)
    whole = notes.agg((F.sum("clicks") / F.sum("views")).alias("b"))
    rate = C.ratio(F.col("clicks"), F.col("views"))
    return notes.crossJoin(F.broadcast(whole)).groupBy(C.threshold_bar(rate, F.col("b")).alias("bar")).agg(F.count("*").alias("notes"))  # one row
