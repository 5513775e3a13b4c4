"""Derived tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import ratio
from tallyforge.sources.staging import spread


def daily_sku_sales(lines: DataFrame, rows: int = 0) -> DataFrame:
    """Units, amount and orders of each shop, day and SKU, refunds left out; an order's lines are added up first, so that orders are counted without a set of them. rows: how many lines, about."""
    keys = ("shop_id", "day", "sku_id")
    sold = lines.where(~F.coalesce("refunded", F.lit(False)))
    by_order = sold.groupBy(*keys, "order_id").agg(F.sum("quantity").alias("units"), F.sum("paid_amount").alias("gmv"))
    return spread(by_order, rows, *keys).groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("gmv").alias("gmv"), F.count("order_id").alias("order_count"))


def shop_daily(lines: DataFrame) -> DataFrame:
    refund = F.sum(F.when(F.col("refunded"), F.col("paid_amount")).otherwise(0.0))
    return lines.groupBy("shop_id", "day").agg(F.sum("paid_amount").alias("gmv"), F.countDistinct("order_id").alias("paid_orders"), F.countDistinct("buyer_id").alias("paid_buyers"), F.sum("quantity").alias("units"), refund.alias("refund_amount"))


def shop_monthly(daily: DataFrame) -> DataFrame:
    return daily.groupBy("shop_id", F.date_format("day", "yyyy-MM").alias("period_month")).agg(F.sum("gmv").alias("gmv"))


def monthly_overview(daily: DataFrame) -> DataFrame:
    """Sums, person-days (never called unique people), daily means and ratios of sums for each month."""
    s = lambda c: F.sum(c)
    out = daily.groupBy("shop_id", F.date_format("day", "yyyy-MM").alias("period_month")).agg(
        s("gmv").alias("gmv"), s("paid_orders").alias("paid_orders"), s("paid_buyers").alias("paid_buyer_days"), F.avg("paid_buyers").alias("avg_daily_paid_buyers"), s("units").alias("paid_units"),
        s("refund_amount").alias("refund_amount_pay"), (s("gmv") - s("refund_amount")).alias("net_gmv_pay"), F.avg(ratio(F.col("gmv"), F.col("paid_orders"))).alias("avg_daily_aov"),
    )
    return out.withColumn("refund_rate_pay", ratio(F.col("refund_amount_pay"), F.col("gmv")))


def sku_performance(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Each SKU's totals with its product's attributes; an order's lines are added up first, so that orders are counted without sets, and SKUs before the join, so that nothing fans out."""
    amount, back = F.col("paid_amount"), F.col("refunded")
    by_order = lines.groupBy("sku_id", "order_id").agg(
        F.sum(amount).alias("gmv"), F.sum("quantity").alias("paid_units"), F.bool_or(back).alias("back"),
        F.sum(F.when(back, amount).otherwise(0.0)).alias("refund_amount"), F.sum(F.when(back, 0.0).otherwise(amount)).alias("net_gmv"),
    )
    sums = by_order.groupBy("sku_id").agg(
        F.sum("gmv").alias("gmv"), F.count("order_id").alias("paid_orders"), F.sum("paid_units").alias("paid_units"), F.count(F.when(F.col("back"), F.col("order_id"))).alias("refund_orders"),
        F.sum("refund_amount").alias("refund_amount"), F.sum("net_gmv").alias("net_gmv"),
    )
    return sums.join(products, "sku_id").withColumn("aov", F.col("gmv") / F.col("paid_orders"))
