"""Registered queries on what data hold: profiles, periods, header audits, rules, published runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import intervals, profiles, rules
from tallyforge.plans import facts
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import FOUND, query
from tallyforge.plans.catalogue_facts import KEY_NUMBERS, KIND, key_numbers
from tallyforge.sources import bindings as B
from tallyforge.sources import matching, publish
from tallyforge.sources.staging import shared_dir, stored

# Profiles

PROFILED = ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most, avg({c})::DOUBLE AS mean"
        f" FROM (SELECT CASE WHEN l_linenumber <> 7 THEN {c} END AS {c} FROM lineitem)"
        for c in PROFILED
    ),
    "least most mean",
)
def _(spark, d):
    """The exact parts of sketches that are kept by month and merged; the seventh lines' cells are left out."""
    line = B.table(spark, d, "lineitem")
    cells = [F.when(F.col("l_linenumber") != 7, F.col(c)).alias(c) for c in PROFILED]
    parts = stored(profiles.sketches(line.select(F.month("l_shipdate").alias("month"), *cells), ["month"]), "profiles")
    number = lambda c: F.col(c).cast("double").alias(c)
    return profiles.described(profiles.merge(parts)).select("column", "rows", "nulls", number("least"), number("most"), "mean")


# Periods

DAYS = """pd AS (SELECT DISTINCT * FROM (SELECT 'orders' AS source, o_custkey AS member, CAST(o_orderdate AS DATE) AS day FROM orders
  UNION ALL SELECT 'lineitem', l_suppkey, CAST(l_shipdate AS DATE) FROM lineitem UNION ALL SELECT 'events', user_id, CAST(ts AS DATE) FROM events))"""
_SOURCES = {"orders": ("o_custkey", "o_orderdate"), "lineitem": ("l_suppkey", "l_shipdate"), "events": ("user_id", "ts")}


def periods(spark, d) -> DataFrame:  # noqa: ANN001
    """A period of a day for each row of three sources, with the customer, supplier or user it is of."""
    each = (B.table(spark, d, t).select(F.lit(t).alias("source"), F.col(m).alias("member"), F.col(c).cast("date").alias("first_day")) for t, (m, c) in _SOURCES.items())
    return reduce(DataFrame.unionByName, each).withColumn("last_day", F.col("first_day"))


_ISLANDS = """SELECT source, member, min(day) AS first_day, max(day) AS last_day, count(*) AS days
  FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY source, member ORDER BY day) AS INT) AS g FROM pd) GROUP BY source, member, g"""


@query("covered_periods", f"SELECT * FROM ({_ISLANDS})", "", T.with_(DAYS))
def _(spark, d):
    return intervals.covered(periods(spark, d), ["source", "member"]).withColumn("days", F.col("days").cast("long"))


@query(
    "missing_periods",
    f"""SELECT source, member, last_day + 1 AS first_day, n - 1 AS last_day, CAST(n - last_day - 1 AS BIGINT) AS days
      FROM (SELECT *, lead(first_day) OVER (PARTITION BY source, member ORDER BY first_day) AS n FROM ({_ISLANDS})) WHERE n IS NOT NULL""",
    "",
    T.with_(DAYS),
)
def _(spark, d):
    return intervals.missing(periods(spark, d), ["source", "member"]).withColumn("days", F.col("days").cast("long"))


@query(
    "shared_periods",
    """SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days, sources, "primary" FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY sources ORDER BY day) AS INT) AS g
      FROM (SELECT day, string_agg(source, ',' ORDER BY source) AS sources, arg_min(source, CASE source WHEN 'lineitem' THEN 1 WHEN 'orders' THEN 2 ELSE 3 END) AS "primary" FROM (SELECT DISTINCT source, day FROM pd) GROUP BY day))
      GROUP BY sources, "primary", g""",
    "",
    T.with_(DAYS),
)
def _(spark, d):
    return intervals.shared(periods(spark, d), "source", {"lineitem": 1, "orders": 2, "events": 3}).withColumn("days", F.col("days").cast("long"))


# Headers

EXPORTS = {
    0: (("sku_id", "sku_id", "chosen"), ("sku_name", "sku_name", "chosen"), ("price", "price", "chosen")),
    1: (("SKU-ID", "sku_id", "chosen"), (" Sku Name", "sku_name", "chosen"), ("unit_price", "price", "chosen"), ("colour", None, "unmatched")),
    2: (("sku_id", "sku_id", "chosen"), ("sku_nme", "sku_name", "review"), ("price", "price", "chosen")),
    3: (("sku_id", "sku_id", "chosen"), ("price", "price", "chosen"), ("unit_price", None, "conflicting")),
}
_EXPECTED = ", ".join(
    f"({k}, '{h}', {f"'{c}'" if c else 'NULL'}, '{o}')" for k, rows in EXPORTS.items() for h, c, o in rows
)


@query(
    "header_audit",
    f"SELECT s_name AS file, h AS \"column\", c AS canonical, o AS outcome FROM supplier JOIN (VALUES {_EXPECTED}) e(k, h, c, o) ON s_suppkey % 4 = k",
)
def _(spark, d):
    """Suppliers export their products under four sets of headers."""
    sets = F.array(*(F.array(*(F.lit(h) for h, _, _ in rows)) for rows in EXPORTS.values()))
    names = B.table(spark, d, "supplier").select(F.col("s_name").alias("file"), F.lit("skus").alias("table_name"), F.explode(sets[(F.col("s_suppkey") % 4).cast("int")]).alias("column"))
    return matching.audit(names, spark).select("file", "column", "canonical", "outcome")


# Rules

RULES = [
    rules.Rule("one gmv", "unique", "gmv"),
    rules.Rule("one refund rate", "unique", "refund_rate_pay"),
    rules.Rule("gmv is money", "unit", "gmv", ("money",)),
    rules.Rule("orders are money", "unit", "paid_orders", ("money",)),
    rules.Rule("refunds have an owner", "owner", "refund_amount_pay", ("refund_structure",)),
    rules.Rule("one owner of rates", "owner", "refund_rate_pay", ("refund_structure",)),
    rules.Rule("aov isn't summed", "caliber", "avg_daily_aov", ("ratio",)),
    rules.Rule("orders may be summed", "caliber", "paid_orders", ("order_count",)),
    rules.Rule("carriers are all", "must_sum_to", "carrier_share", (1.0, 1e-6)),
    rules.Rule("rates are rates", "bounds", "refund_rate_pay", (0.0, 0.3)),
    rules.Rule("nothing to check", "known", "absent"),
]
_TOLD = """t AS (SELECT *, CASE WHEN metric_key IN ('gmv', 'paid_orders', 'avg_daily_aov') THEN 'sum' ELSE 'direct' END AS aggregation FROM (SELECT * FROM kn
  UNION ALL SELECT shop_id, 'channel_structure', 'carrier_share', sum(paid_amount) / sum(sum(paid_amount)) OVER (PARTITION BY shop_id) FROM ol GROUP BY shop_id, carrier))"""


def _rule_sql(name: str, kind: str, metric: str, failed: str, groups: bool = False) -> str:
    name = name.replace("'", "''")
    if not groups:
        return f"SELECT '{name}' AS rule, '{kind}' AS kind, '{metric}' AS metric, count(*) AS checked, count(*) FILTER ({failed}) AS failed FROM t WHERE metric_key = '{metric}'"
    by_group = f"SELECT shop_id, {failed} AS bad FROM t WHERE metric_key = '{metric}' GROUP BY shop_id"
    return f"SELECT '{name}', '{kind}', '{metric}', count(*), count(*) FILTER (bad) FROM ({by_group})"


_CHECKS = " UNION ALL ".join((
    _rule_sql("gmv is money", "unit", "gmv", f"{KIND} <> 'money'"), _rule_sql("one gmv", "unique", "gmv", "max(value) - min(value) > 1e-9 * greatest(abs(max(value)), abs(min(value)))", True),
    _rule_sql("one refund rate", "unique", "refund_rate_pay", "max(value) - min(value) > 1e-9 * greatest(abs(max(value)), abs(min(value)))", True), _rule_sql("orders are money", "unit", "paid_orders", f"{KIND} <> 'money'"),
    _rule_sql("refunds have an owner", "owner", "refund_amount_pay", "task_id <> 'refund_structure'"), _rule_sql("one owner of rates", "owner", "refund_rate_pay", "task_id <> 'refund_structure'"),
    _rule_sql("aov isn't summed", "caliber", "avg_daily_aov", "aggregation NOT IN ('direct', 'mean_of_daily_ratios', 'ratio_of_sums')"),
    _rule_sql("orders may be summed", "caliber", "paid_orders", "aggregation NOT IN ('direct', 'sum', 'mean_daily')"),
    _rule_sql("carriers are all", "must_sum_to", "carrier_share", "abs(sum(value) - 1) > 1e-6", True), _rule_sql("rates are rates", "bounds", "refund_rate_pay", "value < 0 OR value > 0.3"),
    _rule_sql("nothing to check", "known", "absent", "value IS NULL"),
))


@query("rule_checks", f"SELECT *, failed = 0 AS holds FROM ({_CHECKS})", "", T.with_(T.ORDER_LINES, T.SHOP_DAY, KEY_NUMBERS, _TOLD))
def _(spark, d):
    shares = FOUND["carrier_structure"].run(spark, d)
    whole = shares.groupBy("shop_id").agg(F.sum("gmv").alias("_g"))
    share = (F.col("gmv") / F.col("_g")).alias("carrier_share")
    rows = key_numbers(spark, d).unionByName(facts.flatten(shares.join(whole, "shop_id").select("shop_id", share), ["shop_id"], "channel_structure"))
    summed = F.when(F.col("metric_key").isin("gmv", "paid_orders", "avg_daily_aov"), "sum").otherwise("direct")
    told = rows.withColumns({"unit": facts.unit_of(F.col("metric_key")), "aggregation": summed})
    return rules.check(told, RULES, ["shop_id"])


@query("published_facts", FOUND["facts"].sql)
def _(spark, d):
    """Two runs are published, from facts that are computed once; the reader gets the second."""
    folder, rows = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}", stored(FOUND["facts"].run(spark, d), "facts")
    publish.publish(spark, {"facts": rows.where("metric_key = 'gmv'")}, folder, "first")
    publish.publish(spark, {"facts": rows, "units": rows.groupBy("unit").count()}, folder, "second")
    return publish.published(spark, folder, "facts")
