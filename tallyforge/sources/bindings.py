"""Canonical tables from the star schema: order lines, products, daily traffic, anchors, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources import harmonise as H
from tallyforge.sources.staging import spread
from tallyforge.sources.workspace import Source, Workspace, mart

SHOPS = 5
#: Columns of order lines: the raw columns that each is made of, and how.
ORDER_LINES = {
    "shop_id": ("l_suppkey", lambda: F.col("l_suppkey") % SHOPS),
    "order_id": ("l_orderkey", lambda: F.col("l_orderkey")),
    "line": ("l_linenumber", lambda: F.col("l_linenumber")),
    "day": ("o_orderdate", lambda: F.col("o_orderdate").cast("date")),
    "sku_id": ("l_partkey", lambda: F.col("l_partkey")),
    "buyer_id": ("o_custkey", lambda: F.col("o_custkey")),
    "quantity": ("l_quantity", lambda: F.col("l_quantity")),
    "paid_amount": ("l_extendedprice l_discount", lambda: F.col("l_extendedprice") * (1 - F.col("l_discount"))),
    "refunded": ("l_returnflag", lambda: F.col("l_returnflag") == "R"),
    "carrier": ("l_linestatus", lambda: F.col("l_linestatus")),
    "spend": ("l_extendedprice l_tax", lambda: F.col("l_extendedprice") * F.col("l_tax")),
    "priority": ("o_orderpriority", lambda: F.col("o_orderpriority")),
    "supplier_id": ("l_suppkey", lambda: F.col("l_suppkey")),
    "reason": ("l_returnflag", lambda: F.col("l_returnflag")),
}
PRODUCTS = {"sku_id": "p_partkey", "sku_name": "p_name", "category_l1": "p_type", "category_l2": "p_brand", "price": "p_retailprice", "size": "p_size"}


def table(spark: SparkSession, source: Source, name: str) -> DataFrame:
    return source.table(name) if isinstance(source, Workspace) else spark.read.parquet(f"{source}/{name}.parquet")


def line_count(spark: SparkSession, source: Source) -> int:
    """How many order lines there are; of a table in files, their footers tell."""
    made = source.marts.get("order_lines") if isinstance(source, Workspace) else None
    return (table(spark, source, "lineitem") if made is None else made).count()


@mart
def order_lines(spark: SparkSession, source: Source) -> DataFrame:
    """One row for each order line, with its shop, day, product, buyer, amounts and refund flag; a column whose raw columns are absent is left out."""
    rows = table(spark, source, "lineitem")
    n = rows.count()
    joined = spread(rows, n, "l_orderkey").join(spread(table(spark, source, "orders"), n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    have = set(joined.columns)
    return joined.select(*(make().alias(c) for c, (raw, make) in ORDER_LINES.items() if have.issuperset(raw.split())))


@mart
def products(spark: SparkSession, source: Source) -> DataFrame:
    part = table(spark, source, "part")
    return part.select(*(F.col(raw).alias(c) for c, raw in PRODUCTS.items() if raw in part.columns))


@mart
def traffic(spark: SparkSession, source: Source) -> DataFrame:
    """Events with their note number k (0 to 99) and day."""
    return table(spark, source, "events").select("event_id", "ts", F.col("ts").cast("date").alias("day"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@mart
def note_funnel(spark: SparkSession, source: Source) -> DataFrame:
    """Counts of each stage for each note k, and what was paid."""
    stage = lambda name: F.count_if(F.col("event_type") == name)
    return traffic(spark, source).groupBy("k").agg(stage("view").alias("views"), stage("click").alias("clicks"), stage("signup").alias("carts"), stage("purchase").alias("orders"), stage("error").alias("refunds"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("gmv"))


@mart
def anchors(spark: SparkSession, source: Source) -> DataFrame:
    """Urgent order lines as publications about their products."""
    return order_lines(spark, source).where("priority = '1-URGENT'").select("shop_id", F.concat_ws("-", "order_id", "line").alias("note_id"), "sku_id", F.col("day").alias("publish_day"))


@mart
def comments(spark: SparkSession, source: Source) -> DataFrame:
    return table(spark, source, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text"))


# Tables of the contracts (see build)


def from_contracts(spark: SparkSession, folder: str) -> Workspace:
    """A workspace over the tables that a build wrote: what they hold of order lines, products, days, notes, links, features and comments.

    All are of one shop, 0. A table or column that the exports lacked is lacking here too.
    """
    built = spark.read.parquet(f"{folder}/manifest").where("status = 'classified'").select("table_name").distinct()
    have = {r.table_name: spark.read.parquet(f"{folder}/{r.table_name}") for r in built.collect()}  # a row for each contract
    out, shop = Workspace(spark, have), F.lit(0).cast("long").alias("shop_id")

    def give(name: str, df: DataFrame, columns: dict[str, str], *more: Column) -> None:
        out.give(name, df.select(*(F.col(raw).alias(c) for c, raw in columns.items() if raw in df.columns), *more))

    if "orders" in have:
        rows = have["orders"]
        back = ~H.counts_as_sale(F.col("refund_status_optional")) if "refund_status_optional" in rows.columns else F.lit(False)
        named = {"order_id": "order_id", "sku_id": "sku_id", "quantity": "quantity", "paid_amount": "paid_amount", "buyer_id": "buyer_id", "carrier": "carrier"}
        give("order_lines", rows, named, shop, F.col("paid_time").cast("date").alias("day"), back.alias("refunded"))
    if "skus" in have:
        rows = have["skus"]
        if "products" in have and "product_id" in rows.columns:
            rows = rows.join(have["products"].drop(*(set(rows.columns) - {"product_id"})), "product_id", "left")
        give("products", rows, {"sku_id": "sku_id", "sku_name": "sku_name", "category_l1": "category", "category_l2": "series", "price": "price", "size": "inventory_optional"})
    if "business_overview_daily" in have:
        named = {"day": "date", "gmv": "gmv", "paid_orders": "paid_orders", "paid_buyers": "paid_buyers", "units": "paid_units", "refund_amount": "refund_amount_pay"}
        give("daily", have["business_overview_daily"], named, shop)
    if "notes" in have:
        notes = have["notes"]
        give("note_funnel", notes, {"k": "note_id", "views": "impressions", "clicks": "reads", "carts": "collects", "orders": "note_paid_orders", "gmv": "note_gmv"})
        if "note_sku_links" in have and "publish_time" in notes.columns:
            links = have["note_sku_links"].select("note_id", "sku_id").distinct()
            give("anchors", links.join(notes, "note_id"), {"note_id": "note_id", "sku_id": "sku_id"}, shop, F.col("publish_time").cast("date").alias("publish_day"))
    if "content_features" in have:
        give("features", have["content_features"], {"k": "note_id", "style": "composition_type", "angle": "copy_angle"})
    if "comments" in have:
        give("comments", have["comments"], {"conv_id": "note_id", "turn": "comment_time", "text": "comment_text"})
    return out
