"""Registered result tables of the analysis tasks that no other module has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.functions import statistics as S
from tallyforge.operators import distribution, paid, series, structure, text
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import BANDS, FOUND, daily, lines, perf, query
from tallyforge.plans.catalogue_structure import ADS, FEAT, GRAMS, PER, SUMS, WIDE, ads, features
from tallyforge.sources import bindings as B

EV, NF = T.with_(T.EVENTS), T.with_(T.EVENTS, T.FUNNEL)
OL, SD = T.with_(T.ORDER_LINES), T.with_(T.ORDER_LINES, T.SHOP_DAY)
SP = T.with_(T.ORDER_LINES, T.SKU_PERF)


def col(name: str) -> Column:
    return F.col(name)


def over(a: str, b: str) -> str:
    """a / b in SQL where b is positive."""
    return f"CASE WHEN {b} > 0 THEN {a} / {b} END"


def users_of(event: str) -> Column:
    return F.countDistinct(F.when(col("event_type") == event, col("user_id")))


USERS = "count(DISTINCT user_id) FILTER (event_type = '{}')"


# Core business


@query(
    "core_snapshot",
    f"""SELECT shop_id, sum(gmv) AS gmv, CAST(sum(paid_orders) AS BIGINT) AS paid_orders,
      CAST(sum(paid_buyers) AS BIGINT) AS paid_buyer_days, avg(paid_buyers) AS avg_daily_paid_buyers, sum(units) AS paid_units,
      avg({over('gmv', 'paid_orders')}) AS avg_daily_aov, count(*) AS days FROM sd GROUP BY shop_id""",
    "gmv avg_daily_paid_buyers paid_units avg_daily_aov",
    SD,
)
def _(spark, d):
    return daily(spark, d).groupBy("shop_id").agg(
        F.sum("gmv").alias("gmv"),
        F.sum("paid_orders").alias("paid_orders"),
        F.sum("paid_buyers").alias("paid_buyer_days"),
        F.avg("paid_buyers").alias("avg_daily_paid_buyers"),
        F.sum("units").alias("paid_units"),
        F.avg(C.ratio(col("gmv"), col("paid_orders"))).alias("avg_daily_aov"),
        F.count("*").alias("days"),
    )


@query(
    "net_revenue_days",
    f"""SELECT shop_id, day, gmv, refund_amount AS refund_amount_pay, gmv - refund_amount AS net_gmv_pay,
      {over('refund_amount', 'gmv')} AS refund_rate_pay, {over('(gmv - refund_amount)', 'gmv')} AS net_retention_rate FROM sd""",
    "gmv refund_amount_pay net_gmv_pay refund_rate_pay net_retention_rate",
    SD,
)
def _(spark, d):
    net = col("gmv") - col("refund_amount")
    return daily(spark, d).select(
        "shop_id",
        "day",
        "gmv",
        col("refund_amount").alias("refund_amount_pay"),
        net.alias("net_gmv_pay"),
        C.ratio(col("refund_amount"), col("gmv")).alias("refund_rate_pay"),
        C.ratio(net, col("gmv")).alias("net_retention_rate"),
    )


@query(
    "traffic_depth",
    f"""SELECT CAST(sum(v) AS BIGINT) AS visitor_days, CAST(sum(pv) AS BIGINT) AS pv, sum(pv) / sum(v) AS pv_per_visitor,
      CAST(sum(p) AS BIGINT) AS product_visitor_days, sum(p) / sum(v) AS product_visitor_share,
      CAST(sum(c) AS BIGINT) AS new_cart_user_days, sum(c) / sum(p) AS product_visitor_to_new_cart, count(*) AS common_days
      FROM (SELECT day, {USERS.format('view')} AS v, count(*) FILTER (event_type = 'view') AS pv, {USERS.format('click')} AS p,
      {USERS.format('signup')} AS c FROM ev GROUP BY day) WHERE v > 0 AND p > 0""",
    "pv_per_visitor product_visitor_share product_visitor_to_new_cart",
    EV,
)
def _(spark, d):
    days = B.traffic(spark, d).groupBy("day").agg(
        users_of("view").alias("v"), F.count_if(col("event_type") == "view").alias("pv"), users_of("click").alias("p"), users_of("signup").alias("c")
    )
    both = days.where("v > 0 AND p > 0").agg(*(F.sum(c).alias(c) for c in ("v", "pv", "p", "c")), F.count("*").alias("common_days"))
    return both.select(
        col("v").alias("visitor_days"),
        "pv",
        C.ratio(col("pv"), col("v")).alias("pv_per_visitor"),
        col("p").alias("product_visitor_days"),
        C.ratio(col("p"), col("v")).alias("product_visitor_share"),
        col("c").alias("new_cart_user_days"),
        C.ratio(col("c"), col("p")).alias("product_visitor_to_new_cart"),
        "common_days",
    )


@query(
    "refund_time_days",
    """SELECT shop_id, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice * (1 - l_discount)) AS refund_amount_refundtime,
      count(DISTINCT l_orderkey) AS refund_orders FROM (SELECT *, l_suppkey % 5 AS shop_id FROM lineitem) WHERE l_returnflag = 'R' GROUP BY ALL""",
    "refund_amount_refundtime",
)
def _(spark, d):
    """Refunds by the day they were made, which is never added to refunds by the day of payment."""
    back = B.table(spark, d, "lineitem").where("l_returnflag = 'R'")
    amount = col("l_extendedprice") * (1 - col("l_discount"))
    return back.groupBy((col("l_suppkey") % B.SHOPS).alias("shop_id"), col("l_shipdate").cast("date").alias("day")).agg(
        F.sum(amount).alias("refund_amount_refundtime"), F.countDistinct("l_orderkey").alias("refund_orders")
    )


# Notes and anchors


@query(
    "funnel_totals",
    f"""SELECT *, {over('clicks', 'views')} AS click_rate, {over('carts', 'clicks')} AS cart_rate, {over('orders', 'carts')} AS pay_rate,
      {over('refunds', 'orders')} AS refund_rate, {over('gmv * 1000', 'views')} AS gmv_per_1k FROM (SELECT count(*) AS notes,
      CAST(sum(views) AS BIGINT) AS views, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(carts) AS BIGINT) AS carts,
      CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(refunds) AS BIGINT) AS refunds, sum(gmv) AS gmv FROM nf)""",
    "gmv click_rate cart_rate pay_rate refund_rate gmv_per_1k",
    NF,
)
def _(spark, d):
    parts = ("views", "clicks", "carts", "orders", "refunds", "gmv")
    s = B.note_funnel(spark, d).agg(F.count("*").alias("notes"), *(F.sum(c).alias(c) for c in parts))
    rate = lambda a, b: C.ratio(col(a), col(b))
    return s.withColumns({
        "click_rate": rate("clicks", "views"), "cart_rate": rate("carts", "clicks"), "pay_rate": rate("orders", "carts"),
        "refund_rate": rate("refunds", "orders"), "gmv_per_1k": C.ratio(col("gmv") * 1000, col("views")),
    })


@query(
    "lift_summary",
    f"""SELECT "window", count(*) AS anchors, count(*) FILTER (matched_sales_days > 0) AS judgable, sum(pre_units) AS pre_units,
      sum(post_units) AS post_units, avg(absolute_lift) AS mean_lift, {over('(sum(post_units) - sum(pre_units))', 'sum(pre_units)')} AS pooled_lift
      FROM ({FOUND['anchored_lift'].sql}) GROUP BY "window" """,
    "pre_units post_units mean_lift pooled_lift",
)
def _(spark, d):
    rows = FOUND["anchored_lift"].run(spark, d)
    pre, post = F.sum("pre_units"), F.sum("post_units")
    return rows.groupBy("window").agg(
        F.count("*").alias("anchors"),
        F.count_if(col("matched_sales_days") > 0).alias("judgable"),
        pre.alias("pre_units"),
        post.alias("post_units"),
        F.avg("absolute_lift").alias("mean_lift"),
        C.ratio(post - pre, pre).alias("pooled_lift"),
    )


WINDOWS = ("d0_1", "d1_3", "d4_7", "d8_14")


@query(
    "response_totals",
    "SELECT *, units / anchors AS units_per_anchor FROM ("
    + " UNION ALL ".join(
        f"SELECT '{w}' AS \"window\", count(*) AS anchors, count(*) FILTER ({w}_units > 0) AS responding, sum({w}_units) AS units FROM rw" for w in WINDOWS
    )
    + ")",
    "units units_per_anchor",
    f"WITH rw AS ({FOUND['response_windows'].sql}) ",
)
def _(spark, d):
    windows = F.array(*(F.struct(F.lit(w).alias("window"), col(f"{w}_units").alias("u")) for w in WINDOWS))
    rows = FOUND["response_windows"].run(spark, d).select(F.inline(windows))
    s = rows.groupBy("window").agg(F.count("*").alias("anchors"), F.count_if(col("u") > 0).alias("responding"), F.sum("u").alias("units"))
    return s.withColumn("units_per_anchor", C.ratio(col("units"), col("anchors")))


@query(
    "angle_effects",
    """SELECT angle, count(DISTINCT k) AS notes, count(DISTINCT k2) AS matched_notes, CAST(sum(views) AS BIGINT) AS views,
      CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(orders) AS BIGINT) AS orders, sum(gmv) AS gmv
      FROM (SELECT DISTINCT k, angle FROM ft) LEFT JOIN pm ON k = k2 GROUP BY angle""",
    "gmv",
    T.with_(T.EVENTS, T.FUNNEL, FEAT, PER),
)
def _(spark, d):
    return structure.group_effects(features(spark, d), B.note_funnel(spark, d), "angle", "k", ["views", "clicks", "orders", "gmv"])


@query(
    "linked_interaction",
    """SELECT sku_id, style, angle, count(DISTINCT k) AS notes, avg(views) AS avg_views
      FROM (SELECT DISTINCT sku_id % 100 AS k, sku_id FROM ol WHERE priority = '1-URGENT') JOIN ft USING (k) LEFT JOIN nf USING (k) GROUP BY ALL""",
    "avg_views",
    T.with_(T.ORDER_LINES, T.EVENTS, T.FUNNEL, FEAT),
)
def _(spark, d):
    """Each SKU's notes by two features; a note counts for every SKU it is linked to."""
    links = B.anchors(spark, d).select((col("sku_id") % 100).alias("k"), "sku_id").distinct()
    rows = features(spark, d).distinct().join(links, "k")
    return structure.interaction(rows, B.note_funnel(spark, d), ["sku_id", "style", "angle"], "k", "views")


@query(
    "style_mix",
    """SELECT coalesce(style, 'unknown') AS style, count(*) AS notes, count(*) / sum(count(*)) OVER () AS notes_share
      FROM (SELECT DISTINCT k, style FROM ft) GROUP BY ALL""",
    "notes_share",
    T.with_(T.EVENTS, FEAT),
)
def _(spark, d):
    pairs = features(spark, d).select("k", F.coalesce("style", F.lit("unknown")).alias("style")).distinct()
    return structure.share_of(pairs.withColumn("notes", F.lit(1)), [], ["style"], ["notes"])


@query(
    "publish_windows",
    """SELECT CASE WHEN hour(ts) >= 5 AND hour(ts) < 11 THEN 'morning' WHEN hour(ts) >= 11 AND hour(ts) < 14 THEN 'noon'
      WHEN hour(ts) >= 14 AND hour(ts) < 18 THEN 'afternoon' WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 'evening' ELSE 'night' END AS slot,
      count(*) AS posts, count(DISTINCT k) AS notes, avg(value) AS avg_value, sum(value) AS total_value FROM ev WHERE event_type = 'view' GROUP BY ALL""",
    "avg_value total_value",
    EV,
)
def _(spark, d):
    posts = B.traffic(spark, d).where("event_type = 'view'").groupBy(C.day_part(F.hour("ts")).alias("slot"))
    return posts.agg(F.count("*").alias("posts"), F.countDistinct("k").alias("notes"), F.avg("value").alias("avg_value"), F.sum("value").alias("total_value"))


@query(
    "referral_totals",
    """SELECT count(*) AS notes, sum(r) AS referral_gmv, sum(g) AS note_gmv, sum(r) / (sum(r) + sum(g)) AS referral_share
      FROM (SELECT k, sum(value) FILTER (event_type = 'signup') AS r, sum(value) FILTER (event_type = 'purchase') AS g FROM ev GROUP BY k)""",
    "referral_gmv note_gmv referral_share",
    EV,
)
def _(spark, d):
    s = FOUND["referral"].run(spark, d).agg(F.count("*").alias("notes"), F.sum("referral_gmv").alias("referral_gmv"), F.sum("note_gmv").alias("note_gmv"))
    return s.withColumn("referral_share", C.ratio(col("referral_gmv"), col("referral_gmv") + col("note_gmv")))


@query(
    "reshoot_candidates",
    """SELECT row_number() OVER (ORDER BY needs_more_data, opportunity_score DESC, conservative_collect_rate DESC, collect_rate DESC, reads DESC, note) AS rank, *
      FROM (SELECT *, conservative_collect_rate * (1 + read_gap_to_max) * (1 + 0.5 * least(coalesce(click_rate, 0.0), 1.0)
        + 0.5 * least(coalesce(order_rate, 0.0), 1.0)) * (1 - refund_penalty) AS opportunity_score
      FROM (SELECT CAST(k AS VARCHAR) AS note, views AS reads, carts AS collects, CASE WHEN views > 0 THEN carts / views ELSE 0.0 END AS collect_rate,
        views / (views + 50.0) * CASE WHEN views > 0 THEN carts / views ELSE 0.0 END AS conservative_collect_rate,
        1 - views / max(views) OVER () AS read_gap_to_max, CASE WHEN views > 0 THEN clicks / views END AS click_rate,
        CASE WHEN clicks > 0 THEN orders / clicks END AS order_rate,
        CASE WHEN gmv > 0 THEN least(greatest(refunds * 10.0 / gmv, 0.0), 1.0) ELSE 0.0 END AS refund_penalty, views < 50 AS needs_more_data FROM nf))
      ORDER BY rank LIMIT 10""",
    "collect_rate conservative_collect_rate read_gap_to_max click_rate order_rate refund_penalty opportunity_score",
    NF,
)
def _(spark, d):
    """A refund counts as an amount of 10, as traffic has no refund amounts."""
    notes = B.note_funnel(spark, d).select(
        col("k").cast("string").alias("note"), col("views").alias("reads"), col("carts").alias("collects"), "clicks", "orders", "gmv",
        (col("refunds") * 10.0).alias("refund_amount"),
    )
    return structure.reshoot_candidates(notes)


# Comments

#: Stand-ins for Latin letters, in the same order, as the comments have no Chinese ones.
HAN = "".join(chr(0x4E00 + i) for i in range(26))
LATIN, STOPS = "abcdefghijklmnopqrstuvwxyz", "et"


@query(
    "cjk_themes",
    f"""SELECT translate(term, '{LATIN}', '{HAN}') AS term, c AS "count", doc_count, doc_count / n AS coverage, c * doc_count / n AS score
      FROM kept t, (SELECT count(DISTINCT conv_id || '-' || turn) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '')
      WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.doc_count = t.doc_count AND length(o.term) > length(t.term) AND contains(o.term, t.term))
      ORDER BY score DESC, c DESC, term LIMIT 10""",
    "coverage score",
    T.with_(GRAMS, f"kept AS (SELECT * FROM kt WHERE NOT contains('{STOPS}', term[1]) AND NOT contains('{STOPS}', term[-1]))"),
)
def _(spark, d):
    """Grams inside runs of Chinese characters that begin and end with no stop character."""
    written = F.translate(F.lower("text"), LATIN, HAN)
    rows = B.comments(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), written.alias("text"))
    return text.themes(rows, "id", "text", script="cjk", stops=F.translate(F.lit(STOPS), LATIN, HAN))


SERIES = ("tion", "the", "zzz")


@query(
    "theme_series",
    " UNION ALL ".join(f"SELECT '{t}' AS term, turn, count(*) FILTER (contains(lower(text), '{t}')) AS doc_count FROM conversations WHERE role = 'user' GROUP BY turn" for t in SERIES),
)
def _(spark, d):
    """A term that a period lacks has zero there, so that it reads as less and not as unknown."""
    return text.theme_series(B.comments(spark, d), "turn", "text", SERIES)


@query(
    "theme_directions",
    "SELECT term, count(*) AS n, regr_slope(c, i) AS slope, " + T.direction("regr_slope(c, i)") + " AS direction FROM (SELECT term, CAST(doc_count AS DOUBLE) AS c,"
    " CAST(row_number() OVER (PARTITION BY term ORDER BY turn) - 1 AS DOUBLE) AS i FROM (" + FOUND["theme_series"].sql + ")) GROUP BY term",
    "slope",
)
def _(spark, d):
    rows = FOUND["theme_series"].run(spark, d).withColumn("c", col("doc_count").cast("double"))
    return series.trend_summary(rows, ["term"], "turn", "c").select("term", col("n").cast("long").alias("n"), "slope", "direction")


# Products


@query(
    "opportunity_types",
    f"SELECT opportunity_type, count(*) AS skus, sum(gmv) AS gmv, sum(units) AS units FROM ({FOUND['product_opportunity'].sql}) GROUP BY opportunity_type",
    "gmv units",
)
def _(spark, d):
    rows = FOUND["product_opportunity"].run(spark, d)
    return rows.groupBy("opportunity_type").agg(F.count("*").alias("skus"), F.sum("gmv").alias("gmv"), F.sum("units").alias("units"))


@query(
    "sku_net_rows",
    f"""SELECT sku_id, sku_name, category_l2, gmv, refund_amount AS refund_amount_pay, net_gmv AS net_gmv_pay,
      {over('refund_amount', 'gmv')} AS refund_rate_pay, {over('net_gmv', 'gmv')} AS net_retention_rate FROM spp""",
    "gmv refund_amount_pay net_gmv_pay refund_rate_pay net_retention_rate",
    SP,
)
def _(spark, d):
    return perf(spark, d).select(
        "sku_id",
        "sku_name",
        "category_l2",
        "gmv",
        col("refund_amount").alias("refund_amount_pay"),
        col("net_gmv").alias("net_gmv_pay"),
        C.ratio(col("refund_amount"), col("gmv")).alias("refund_rate_pay"),
        C.ratio(col("net_gmv"), col("gmv")).alias("net_retention_rate"),
    )


# Paid traffic

CAPABILITY = {"exposure": "impressions", "click": "clicks", "conversion": "orders", "gmv": "gmv"}


@query(
    "ad_capabilities",
    "SELECT region, count(*) AS rows, min(day) AS first_date, max(day) AS last_date, sum(spend) AS total_spend, "
    + ", ".join(f"coalesce(sum({c}), 0) > 0 AS has_{n}_metrics" for n, c in CAPABILITY.items())
    + """, count(supplier) AS creative_link_rows, count(nation) AS unit_link_rows,
      CASE WHEN count(supplier) > 0 THEN 'creative' WHEN count(nation) > 0 THEN 'unit' ELSE 'campaign' END AS detected_grain
      FROM (SELECT day, region, spend, impressions, clicks, orders, gmv, CASE WHEN region % 2 = 0 THEN supplier END AS supplier,
        CASE WHEN region % 3 <> 1 THEN nation END AS nation FROM ad) GROUP BY region""",
    "total_spend",
    T.with_(ADS),
)
def _(spark, d):
    """Regions whose exports stop at the unit or the campaign have no finer ids."""
    rows = ads(spark, d).withColumns({"supplier": F.when(col("region") % 2 == 0, col("supplier")), "nation": F.when(col("region") % 3 != 1, col("nation"))})
    return paid.capabilities(rows, ["region"], CAPABILITY, {"creative": "supplier", "unit": "nation"}, "campaign")


@query(
    "paid_reported",
    f"""SELECT *, {over('clicks', 'impressions')} AS ctr_calc, {over('spend * 1000', 'impressions')} AS cpm_calc,
      coalesce({over('spend * 1000', 'impressions')}, cpm_reported) AS cpm_effective,
      {over('spend * 1000', 'impressions')} - cpm_reported AS cpm_gap FROM (SELECT region, {SUMS},
      coalesce(sum(r * impressions) FILTER (r IS NOT NULL AND impressions > 0) / nullif(sum(impressions) FILTER (r IS NOT NULL AND impressions > 0), 0), avg(r)) AS cpm_reported
      FROM (SELECT *, CASE WHEN supplier % 4 <> 0 THEN round(spend / impressions * 1000, 1) END AS r FROM ad) GROUP BY region)""",
    "spend gmv cpm_reported ctr_calc cpm_calc cpm_effective cpm_gap",
    T.with_(ADS),
    digits=2,
)
def _(spark, d):
    """Reported prices are means weighted by their impressions; one supplier in four reports none."""
    reported = F.when(col("supplier") % 4 != 0, F.round(col("spend") / col("impressions") * 1000, 1))
    return paid.reported_gap(ads(spark, d).withColumn("cpm", reported), ["region"])


# Refunds


@query(
    "refund_axes",
    """SELECT shop_id, axis, layer, sum(paid_amount) AS refund_amount, sum(paid_amount) / sum(sum(paid_amount)) OVER (PARTITION BY shop_id, axis) AS share
      FROM (SELECT shop_id, paid_amount, unnest(['ship_stage', 'return_type']) AS axis,
        unnest([carrier, CASE WHEN quantity >= 25 THEN 'return' ELSE 'refund_only' END]) AS layer FROM ol WHERE refunded) GROUP BY shop_id, axis, layer""",
    "refund_amount share",
    OL,
)
def _(spark, d):
    """Two ways to split refunds; each has its own whole, as they can't be added."""
    kind = F.when(col("quantity") >= 25, "return").otherwise("refund_only")
    layers = F.array(*(F.struct(F.lit(axis).alias("axis"), layer.alias("layer")) for axis, layer in (("ship_stage", col("carrier")), ("return_type", kind))))
    rows = lines(spark, d).where("refunded").select("shop_id", col("paid_amount").alias("refund_amount"), F.inline(layers))
    return structure.share_of(rows, ["shop_id", "axis"], ["layer"], ["refund_amount"]).withColumnRenamed("refund_amount_share", "share")


@query(
    "refund_price_bands",
    f"""SELECT CAST(band AS BIGINT) AS band, low, high, CAST(sum(paid_orders) AS BIGINT) AS paid_orders,
      {over('sum(refund_orders)', 'sum(paid_orders)')} AS refund_rate, sum(gmv) / sum(sum(gmv)) OVER () AS gmv_share FROM bd GROUP BY band, low, high""",
    "low high refund_rate gmv_share",
    T.with_(T.ORDER_LINES, T.SKU_PERF, BANDS),
)
def _(spark, d):
    rows = distribution.banded(perf(spark, d), [], "price")
    s = structure.share_of(rows, [], ["band", "low", "high"], ["paid_orders", "refund_orders", "gmv"])
    return s.select("band", "low", "high", "paid_orders", C.ratio(col("refund_orders"), col("paid_orders")).alias("refund_rate"), "gmv_share")


@query(
    "refund_stages",
    f"""SELECT shop_id, stage, orders, refund_orders, refund_orders / orders AS rate, {T.wilson('refund_orders', 'orders', True)} AS ci_low,
      {T.wilson('refund_orders', 'orders', False)} AS ci_high FROM (SELECT shop_id, CASE carrier WHEN 'O' THEN 'pre_ship' ELSE 'post_ship' END AS stage,
      count(DISTINCT order_id) AS orders, count(DISTINCT CASE WHEN refunded THEN order_id END) AS refund_orders FROM ol GROUP BY ALL)""",
    "rate ci_low ci_high",
    OL,
)
def _(spark, d):
    stage = F.when(col("carrier") == "O", "pre_ship").otherwise("post_ship")
    orders, back = F.countDistinct("order_id"), F.countDistinct(F.when(col("refunded"), col("order_id")))
    s = lines(spark, d).groupBy("shop_id", stage.alias("stage")).agg(orders.alias("orders"), back.alias("refund_orders"))
    low, high = S.wilson(col("refund_orders"), col("orders"))
    return s.withColumns({"rate": C.ratio(col("refund_orders"), col("orders")), "ci_low": low, "ci_high": high})


# Channels


@query(
    "channel_scale",
    """SELECT carrier, gmv, gmv / sum(gmv) OVER () AS gmv_share, paid_orders, paid_orders / sum(paid_orders) OVER () AS order_share, buyers, net_gmv
      FROM (SELECT carrier, sum(paid_amount) AS gmv, count(DISTINCT order_id) AS paid_orders, count(DISTINCT buyer_id) AS buyers,
      sum(CASE WHEN refunded THEN 0 ELSE paid_amount END) AS net_gmv FROM ol GROUP BY carrier)""",
    "gmv gmv_share order_share net_gmv",
    OL,
)
def _(spark, d):
    amount = col("paid_amount")
    s = lines(spark, d).groupBy("carrier").agg(
        F.sum(amount).alias("gmv"),
        F.countDistinct("order_id").alias("paid_orders"),
        F.countDistinct("buyer_id").alias("buyers"),
        F.sum(F.when(col("refunded"), 0.0).otherwise(amount)).alias("net_gmv"),
    )
    whole = s.agg(F.sum("gmv").alias("_g"), F.sum("paid_orders").alias("_o"))
    s = s.crossJoin(F.broadcast(whole))  # one row
    return s.withColumns({"gmv_share": C.ratio(col("gmv"), col("_g")), "order_share": C.ratio(col("paid_orders"), col("_o"))}).drop("_g", "_o")


@query(
    "carrier_days",
    f"""SELECT shop_id, day, carrier, gmv, paid_orders, buyers, round({over('gmv', 'paid_orders')}) AS aov, net_gmv_pay, refund_orders_pay,
      {over('refund_orders_pay', 'paid_orders')} AS refund_rate FROM (SELECT shop_id, day, carrier, sum(paid_amount) AS gmv,
      count(DISTINCT order_id) AS paid_orders, count(DISTINCT buyer_id) AS buyers, sum(CASE WHEN refunded THEN 0 ELSE paid_amount END) AS net_gmv_pay,
      count(DISTINCT CASE WHEN refunded THEN order_id END) AS refund_orders_pay FROM ol GROUP BY ALL)""",
    "gmv aov net_gmv_pay refund_rate",
    OL,
)
def _(spark, d):
    """The order value is in whole units."""
    amount = col("paid_amount")
    s = lines(spark, d).groupBy("shop_id", "day", "carrier").agg(
        F.sum(amount).alias("gmv"),
        F.countDistinct("order_id").alias("paid_orders"),
        F.countDistinct("buyer_id").alias("buyers"),
        F.sum(F.when(col("refunded"), 0.0).otherwise(amount)).alias("net_gmv_pay"),
        F.countDistinct(F.when(col("refunded"), col("order_id"))).alias("refund_orders_pay"),
    )
    return s.withColumns({"aov": F.round(C.ratio(col("gmv"), col("paid_orders"))), "refund_rate": C.ratio(col("refund_orders_pay"), col("paid_orders"))})


@query(
    "carrier_prefixes",
    "SELECT shop_id, day, 'F' AS carrier, F_gmv AS gmv, F_orders AS orders FROM wd UNION ALL SELECT shop_id, day, 'O', O_gmv, O_orders FROM wd",
    "gmv",
    T.with_(T.ORDER_LINES, WIDE),
)
def _(spark, d):
    """Carriers are whatever prefixes the columns have."""
    wide = lines(spark, d).groupBy("shop_id", "day").pivot("carrier").agg(F.sum("paid_amount").alias("gmv"), F.count(F.lit(1)).alias("orders"))
    counts = {c: F.coalesce(c, F.lit(0)).alias(c) if c.endswith("_orders") else col(c) for c in wide.columns}
    return structure.unpivot_prefixes(wide.select(*counts.values()), ["shop_id", "day"], ["gmv", "orders"])


@query(
    "gated_compare",
    f"SELECT category_l1, diff, z, significant, significant AND abs(diff) >= 0.02 AS matters FROM ({FOUND['top2_compare'].sql})",
    "diff z",
)
def _(spark, d):
    """A difference counts where it is significant and two points or more."""
    rows = FOUND["top2_compare"].run(spark, d)
    return rows.select("category_l1", "diff", "z", "significant", S.gated(col("significant"), col("diff"), 0.02).alias("matters"))


# Demand, search, audience


@query(
    "wishlist_days",
    f"""SELECT day, new_wishlist_users, add_to_cart_users, {over('new_wishlist_users', 'add_to_cart_users')} AS wishlist_to_cart
      FROM (SELECT day, {USERS.format('click')} AS new_wishlist_users, {USERS.format('signup')} AS add_to_cart_users FROM ev GROUP BY day)""",
    "wishlist_to_cart",
    EV,
)
def wishlist_days(spark, d):
    """Clicks stand for wishlists. Users are distinct within a day: sums over days are user-days."""
    s = B.traffic(spark, d).groupBy("day").agg(users_of("click").alias("new_wishlist_users"), users_of("signup").alias("add_to_cart_users"))
    return s.withColumn("wishlist_to_cart", C.ratio(col("new_wishlist_users"), col("add_to_cart_users")))


@query(
    "wishlist_trend",
    f"""SELECT CAST(sum(w) AS BIGINT) AS new_wishlist_user_days, avg(w) AS avg_daily_new_wishlist_users, avg({over('w', 'c')}) AS avg_daily_wishlist_to_cart,
      regr_slope(w, i) AS slope, {T.direction('regr_slope(w, i)')} AS wishlist_trend
      FROM (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS DOUBLE) AS i, {USERS.format('click')} AS w, {USERS.format('signup')} AS c FROM ev GROUP BY day)""",
    "avg_daily_new_wishlist_users avg_daily_wishlist_to_cart slope",
    EV,
)
def _(spark, d):
    days = wishlist_days(spark, d).withColumn("w", col("new_wishlist_users").cast("double"))
    trend = series.trend_summary(days, [], "day", "w").select("slope", col("direction").alias("wishlist_trend"))
    s = days.agg(
        F.sum("new_wishlist_users").alias("new_wishlist_user_days"), F.avg("w").alias("avg_daily_new_wishlist_users"), F.avg("wishlist_to_cart").alias("avg_daily_wishlist_to_cart")
    )
    return s.crossJoin(F.broadcast(trend))  # one row each


@query("search_coverage", f"SELECT click_source, count(*) AS rows, sum(click_users) AS click_users FROM ({FOUND['search_funnel'].sql}) GROUP BY click_source", "click_users")
def _(spark, d):
    return FOUND["search_funnel"].run(spark, d).groupBy("click_source").agg(F.count("*").alias("rows"), F.sum("click_users").alias("click_users"))


@query(
    "search_leaks",
    """SELECT term, views, clicks, orders, click_rate, order_rate, CASE WHEN click_rate < cb THEN 'click_leak' WHEN order_rate < ob THEN 'conversion_leak' ELSE 'leak' END AS leak_type
      FROM (SELECT *, clicks / nullif(views, 0) AS click_rate, orders / nullif(clicks, 0) AS order_rate, sum(clicks) OVER () / sum(views) OVER () AS cb,
        sum(orders) OVER () / sum(clicks) OVER () AS ob, sum(orders) OVER () / sum(views) OVER () AS vb
        FROM (SELECT k AS term, views, clicks, orders FROM nf)) WHERE views > 0 AND orders / views < vb""",
    "click_rate order_rate",
    NF,
)
def _(spark, d):
    """Terms that sell less than all do, by the step at which they lose."""
    return structure.leaks(B.note_funnel(spark, d).withColumnRenamed("k", "term"), "term", "views", "clicks", "orders")


@query(
    "audience_conversion",
    f"""SELECT *, {over('click_users', 'visitors')} AS visit_click_rate, {over(T.clamp('payers', 'click_users'), 'click_users')} AS click_pay_rate,
      {over(T.clamp('payers', 'visitors'), 'visitors')} AS conversion, {T.wilson('payers', 'visitors', True)} AS ci_low, {T.wilson('payers', 'visitors', False)} AS ci_high
      FROM (SELECT user_id % 5 AS audience, {USERS.format('view')} AS visitors, {USERS.format('click')} AS click_users, {USERS.format('purchase')} AS payers FROM ev GROUP BY ALL)""",
    "visit_click_rate click_pay_rate conversion ci_low ci_high",
    EV,
)
def _(spark, d):
    s = B.traffic(spark, d).groupBy((col("user_id") % 5).alias("audience")).agg(
        users_of("view").alias("visitors"), users_of("click").alias("click_users"), users_of("purchase").alias("payers")
    )
    low, high = S.wilson(col("payers"), col("visitors"))
    rate = lambda k, n: C.ratio(S.clamp(col(k), col(n)), col(n))
    return s.withColumns({
        "visit_click_rate": C.ratio(col("click_users"), col("visitors")), "click_pay_rate": rate("payers", "click_users"),
        "conversion": rate("payers", "visitors"), "ci_low": low, "ci_high": high,
    })


def cycles(events: DataFrame) -> DataFrame:
    """Users by the days from their first to their last purchase."""
    paid_days = F.when(col("event_type") == "purchase", col("day"))
    each = events.groupBy("user_id").agg(
        F.datediff(F.max(paid_days), F.min(paid_days)).alias("span"), F.count_if(col("event_type") == "view").alias("views"), F.count_if(col("event_type") == "purchase").alias("paid")
    )
    cycle = F.when(col("span").isNull(), "none").when(col("span") < 7, "under a week").when(col("span") < 21, "under three weeks").otherwise("longer")
    return each.withColumn("cycle", cycle)


@query(
    "cycle_conversion",
    f"""SELECT cycle, users, visitors, payers, {over(T.clamp('payers', 'visitors'), 'visitors')} AS conversion, {T.wilson('payers', 'visitors', True)} AS ci_low,
      {T.wilson('payers', 'visitors', False)} AS ci_high FROM (SELECT cycle, count(*) AS users, CAST(sum(v) AS BIGINT) AS visitors, CAST(sum(p) AS BIGINT) AS payers
      FROM (SELECT v, p, CASE WHEN s IS NULL THEN 'none' WHEN s < 7 THEN 'under a week' WHEN s < 21 THEN 'under three weeks' ELSE 'longer' END AS cycle
      FROM (SELECT user_id, max(day) FILTER (event_type = 'purchase') - min(day) FILTER (event_type = 'purchase') AS s,
      count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS p FROM ev GROUP BY user_id)) GROUP BY cycle)""",
    "conversion ci_low ci_high",
    EV,
)
def _(spark, d):
    s = cycles(B.traffic(spark, d)).groupBy("cycle").agg(F.count("*").alias("users"), F.sum("views").alias("visitors"), F.sum("paid").alias("payers"))
    low, high = S.wilson(col("payers"), col("visitors"))
    return s.withColumns({"conversion": C.ratio(S.clamp(col("payers"), col("visitors")), col("visitors")), "ci_low": low, "ci_high": high})
