"""Registered queries on ratios of single rows: notes, ads, refunds and how rates are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.functions import statistics as S
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import lines, query
from tallyforge.plans.catalogue_structure import ADS, ads
from tallyforge.sources import bindings as B

_DIV = "CASE WHEN {1} > 0 THEN {0} / {1} END AS {2}".format


@query(
    "note_ratios",
    f"""SELECT k, {_DIV("clicks", "views", "read_rate")}, CASE WHEN clicks > 0 THEN CAST(0 AS DOUBLE) END AS like_rate, {_DIV("carts", "clicks", "collect_rate")}, {_DIV("refunds", "clicks", "comment_rate")},
    {_DIV("(carts + refunds)", "clicks", "engagement_rate")}, {_DIV("orders", "carts", "click_to_order")}, {_DIV("gmv", "carts", "gmv_per_click")} FROM nf""",
    "read_rate like_rate collect_rate comment_rate engagement_rate click_to_order gmv_per_click", T.with_(T.EVENTS, T.FUNNEL),
)
def _(spark, d):
    """Events as a note's figures; likes and shares are columns that the table lacks."""
    names = {"views": "impressions", "clicks": "reads", "refunds": "comments", "orders": "note_paid_orders", "gmv": "note_gmv"}
    notes = B.note_funnel(spark, d).withColumns({"collects": F.col("carts"), "product_clicks": F.col("carts")}).withColumnsRenamed(names)
    return C.note_ratios(notes).select("k", "read_rate", "like_rate", "collect_rate", "comment_rate", "engagement_rate", "click_to_order", "gmv_per_click")


@query(
    "ad_ratios",
    f"""SELECT nation, month, {_DIV("clicks", "impressions", "ctr_calc")}, {_DIV("spend", "clicks", "cpc_calc")}, {_DIV("spend * 1000", "impressions", "cpm_calc")}, CAST(NULL AS DOUBLE) AS cvr_calc, {_DIV("spend", "orders", "cost_per_order_calc")},
    {_DIV("gmv", "spend", "roas_calc")} FROM (SELECT nation, strftime(day, '%Y-%m') AS month, sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(orders) AS orders, sum(gmv) AS gmv FROM ad GROUP BY ALL)""",
    "ctr_calc cpc_calc cpm_calc cost_per_order_calc roas_calc", T.with_(ADS),
)
def _(spark, d):
    """Ad rows of a nation's month; conversions are a column that the table lacks."""
    rows = ads(spark, d).groupBy("nation", F.date_format("day", "yyyy-MM").alias("month")).agg(*(F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "orders", "gmv")))
    out = C.ad_ratios(rows.withColumnsRenamed({"orders": "orders_optional", "gmv": "gmv_optional"}))
    return out.select("nation", "month", "ctr_calc", "cpc_calc", "cpm_calc", "cvr_calc", "cost_per_order_calc", "roas_calc")


_SHOWN = "CASE " + " ".join(f"WHEN printf('%.{n}f', lo * 100) <> printf('%.{n}f', hi * 100) THEN '约 ' || printf('%.{n}f', lo * 100) || '%–' || printf('%.{n}f', hi * 100) || '%'" for n in range(3)) + " ELSE '约 ' || printf('%.0f', hi * 100) || '%' END"


@query(
    "refund_bands",
    f"""SELECT sku_group, {_SHOWN} AS band, refund_orders / n AS refund_order_rate, refunded / gmv AS refund_rate, gmv - refunded AS net_gmv, gmv / buyers AS gmv_per_buyer FROM
    (SELECT *, {T.wilson("refund_orders", "n", True)} AS lo, {T.wilson("refund_orders", "n", False)} AS hi FROM (SELECT sku_id % 200 AS sku_group, count(DISTINCT order_id) AS n, count(DISTINCT buyer_id) AS buyers,
    count(DISTINCT CASE WHEN refunded THEN order_id END) AS refund_orders, sum(paid_amount) AS gmv, sum(CASE WHEN refunded THEN paid_amount ELSE 0 END) AS refunded FROM ol GROUP BY ALL))""",
    "refund_order_rate refund_rate net_gmv gmv_per_buyer", T.with_(T.ORDER_LINES),
)
def _(spark, d):
    """Refunds of groups of SKUs: their Wilson interval as it is shown, rates, what is left, and the amount for each buyer."""
    back, paid = F.col("refunded"), F.col("paid_amount")
    s = lines(spark, d).groupBy((F.col("sku_id") % 200).alias("sku_group")).agg(
        F.countDistinct("order_id").alias("n"), F.countDistinct("buyer_id").alias("buyers"), F.countDistinct(F.when(back, F.col("order_id"))).alias("refund_orders"), F.sum(paid).alias("gmv"), F.sum(F.when(back, paid).otherwise(0.0)).alias("refund")
    )
    low, high = S.wilson(F.col("refund_orders"), F.col("n"))
    gmv, refund = F.col("gmv"), F.col("refund")
    return s.select(
        "sku_group", C.rate_band(low, high).alias("band"), C.share_of(F.col("refund_orders"), F.col("n")).alias("refund_order_rate"), C.share_of(refund, gmv).alias("refund_rate"), C.net_gmv(gmv, refund).alias("net_gmv"),
        C.per_visitor_gmv(gmv, F.col("buyers")).alias("gmv_per_buyer"),
    )
