"""Registered queries on structure, paid traffic, bridges, text, merging and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.functions import statistics as S
from tallyforge.operators import bridge, paid, series, structure, text
from tallyforge.operators.ranks import top_rows, with_group
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import daily, lines, perf, query
from tallyforge.sources import bindings as B
from tallyforge.sources import harmonise as H
from tallyforge.sources.staging import stored
from tallyforge.sources.workspace import mart

EV, NF, OL, SD, SP = T.with_(T.EVENTS), T.with_(T.EVENTS, T.FUNNEL), T.with_(T.ORDER_LINES), T.with_(T.ORDER_LINES, T.SHOP_DAY), T.with_(T.ORDER_LINES, T.SKU_PERF)

# Merge, quality, cleaning

FILES = """a AS (SELECT p_partkey AS sku_id, p_name AS sku_name, CAST(NULL AS VARCHAR) AS brand, p_retailprice AS price FROM part WHERE p_partkey % 3 <> 0),
 b AS (SELECT p_partkey AS sku_id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS sku_name, p_brand AS brand, p_retailprice * CASE WHEN p_partkey % 5 = 0 THEN 1.2 WHEN p_partkey % 5 = 1 THEN 1.03 ELSE 1 END AS price FROM part WHERE p_partkey % 3 <> 1)"""


def two_files(spark, d):
    part = B.table(spark, d, "part")
    a = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("sku_id"), F.col("p_name").alias("sku_name"), F.lit(None).cast("string").alias("brand"), F.col("p_retailprice").alias("price"))
    gap = F.when(F.col("p_partkey") % 5 == 0, 1.2).when(F.col("p_partkey") % 5 == 1, 1.03).otherwise(1)
    b = part.where("p_partkey % 3 <> 1").select(F.col("p_partkey").alias("sku_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("sku_name"), F.col("p_brand").alias("brand"), (F.col("p_retailprice") * gap).alias("price"))
    return H.tagged([a, b])


@query("grain_merge", "SELECT sku_id, coalesce(a.sku_name, b.sku_name) AS sku_name, coalesce(a.brand, b.brand) AS brand, coalesce(a.price, b.price) AS price FROM a FULL JOIN b USING (sku_id)", "price", T.with_(FILES))
def _(spark, d):
    return H.grain_merge(two_files(spark, d), ["sku_id"])


@query("merge_conflicts", "SELECT sku_id, count(*) AS conflicts FROM a JOIN b USING (sku_id) WHERE abs(a.price - b.price) > 0.05 * greatest(abs(a.price), abs(b.price)) GROUP BY sku_id", "", T.with_(FILES))
def _(spark, d):
    return H.merge_conflicts(two_files(spark, d), ["sku_id"]).groupBy("sku_id").agg(F.count("*").alias("conflicts"))


@query("build_statistics", "SELECT CAST(count(*) AS BIGINT) AS input_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS duplicate_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS accepted_rows, (SELECT count(DISTINCT sku_id) FROM u) AS merged_rows FROM u", "", T.with_(FILES, "u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a WHERE sku_id % 2 = 0)"))
def _(spark, d):
    rows = two_files(spark, d)
    return H.build_statistics(rows.unionByName(rows.where("_file = 0 AND sku_id % 2 = 0")), ["sku_id"])


@query("order_line_validation", "SELECT coalesce(CASE WHEN q % 10 = 0 THEN 'quantity: not a whole positive number' WHEN q % 17 = 0 THEN 'paid_amount: not a finite amount of 0 or more' END, 'good') AS outcome, count(*) AS rows FROM (SELECT l_orderkey AS q FROM lineitem) GROUP BY ALL")
def _(spark, d):
    raw = B.table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("sku_id"), F.when(F.col("l_orderkey") % 10 == 0, F.lit("1.5")).otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(F.col("l_orderkey") % 17 == 0, F.lit("—")).otherwise(F.concat(F.lit("¥"), F.format_number("l_extendedprice", 2))).alias("paid_amount"),
    )
    return H.mark_orders(raw).groupBy(F.coalesce("invalid_reason", F.lit("good")).alias("outcome")).agg(F.count("*").alias("rows"))


@query(
    "order_moments",
    "SELECT CASE WHEN k = 4 THEN 'unread' ELSE 'read' END AS outcome, CASE WHEN k <> 4 THEN strftime(m, '%Y-%m-%d %H:%M:%S') END AS moment, count(*) AS orders FROM "
    "(SELECT o_orderkey % 5 AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_minutes(CASE WHEN o_orderkey % 5 = 3 THEN 0 ELSE CAST(o_orderkey % 96 * 15 AS BIGINT) END) AS m FROM orders) GROUP BY ALL",
)
def _(spark, d):
    """Order times as exports write them: ISO, slashed, a spreadsheet's day number, a bare day, and text that is no time."""
    minutes, kind, day = (F.col("o_orderkey") % 96 * 15).cast("int"), F.col("o_orderkey") % 5, F.col("o_orderdate").cast("date")
    clock = F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), minutes % 60)
    number = F.datediff(day, F.lit("1899-12-30").cast("date")) + minutes / 1440
    raw = (
        F.when(kind == 0, F.concat_ws("T", day.cast("string"), F.concat(clock, F.lit(":00")))).when(kind == 1, F.concat_ws(" ", F.date_format(day, "yyyy/M/d"), clock))
        .when(kind == 2, number.cast("string")).when(kind == 3, F.date_format(day, "yyyyMMdd")).otherwise("soon")
    )
    rows = B.table(spark, d, "orders").select(raw.alias("raw")).select(C.parse_timestamp(F.col("raw")).alias("m"))
    return rows.groupBy(F.when(F.col("m").isNull(), "unread").otherwise("read").alias("outcome"), F.date_format("m", "yyyy-MM-dd HH:mm:ss").alias("moment")).agg(F.count("*").alias("orders"))


@query("clean_numbers", "SELECT l_linenumber AS line, sum(l_extendedprice) AS amount, avg(l_discount) AS rate, count(*) FILTER (l_tax * 100 > 1) AS percent_rows FROM lineitem GROUP BY ALL", "amount rate")
def _(spark, d):
    shown = B.table(spark, d, "lineitem").select("l_linenumber", F.concat(F.lit(" ¥"), F.format_number("l_extendedprice", 2)).alias("p"), F.concat((F.col("l_discount") * 100).cast("decimal(9,4)").cast("string"), F.lit("%")).alias("r"), (F.col("l_tax") * 100).alias("t"))
    rate = F.when(F.col("r") == "1.0000%", 0.01).otherwise(C.bounded_rate(C.to_finite(F.col("r"))))  # a bare 1 would read as all
    return shown.groupBy(F.col("l_linenumber").alias("line")).agg(F.sum(C.to_finite(F.col("p"))).alias("amount"), F.avg(rate).alias("rate"), F.count_if(F.col("t") > 1).alias("percent_rows"))


@query("period_keys", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso_day, strftime(o_orderdate, '%G-W%V') AS iso_week, strftime(o_orderdate, '%Y-%m') AS period, CAST(strftime(last_day(CAST(o_orderdate AS DATE)), '%Y%m%d') AS INTEGER) AS month_end, count(*) AS orders FROM orders GROUP BY ALL")
def _(spark, d):
    as_int = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    rows = B.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, as_int.cast("string")).otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("raw"))
    period = F.date_format(C.parse_day(F.col("raw")), "yyyy-MM")
    return rows.groupBy(C.iso_day(F.col("raw")).alias("iso_day"), C.iso_week(C.parse_day(F.col("raw"))).alias("iso_week"), period.alias("period"), C.month_end(period).alias("month_end")).agg(F.count("*").alias("orders"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, count(*) = 0 AS is_empty FROM {t}" for t in ("orders", "lineitem", "part", "events", "conversations")))
def _(spark, d):
    each = [B.table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows", (F.col("rows") == 0).alias("is_empty")) for t in ("orders", "lineitem", "part", "events", "conversations")]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


@query("source_summary", "SELECT 'orders' AS source, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, count(*) AS rows FROM orders UNION ALL SELECT 'events', min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), count(*) FROM events")
def _(spark, d):
    span = lambda t, c: B.table(spark, d, t).agg(F.min(F.col(c).cast("date")).alias("first_day"), F.max(F.col(c).cast("date")).alias("last_day"), F.count("*").alias("rows")).select(F.lit(t).alias("source"), "first_day", "last_day", "rows")
    return span("orders", "o_orderdate").unionByName(span("events", "ts"))


# Features and mixes

FEAT = "ft AS (SELECT DISTINCT k, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'style' || (user_id % 4) END AS style, 'angle' || (event_id % 3) AS angle FROM ev)"
PER = "pm AS (SELECT k AS k2, views, clicks, orders, gmv FROM nf)"


@mart
def features(spark, d):
    u = F.col("user_id") % 4
    return B.traffic(spark, d).select("k", F.when(u != 0, F.concat(F.lit("style"), u)).alias("style"), F.concat(F.lit("angle"), F.col("event_id") % 3).alias("angle"))


@query("group_effects", "SELECT coalesce(style, 'unknown') AS style, count(DISTINCT k) AS notes, count(DISTINCT k2) AS matched_notes, CAST(sum(views) AS BIGINT) AS views, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(orders) AS BIGINT) AS orders, sum(gmv) AS gmv FROM (SELECT DISTINCT k, style FROM ft) LEFT JOIN pm ON k = k2 GROUP BY ALL", "gmv", T.with_(T.EVENTS, T.FUNNEL, FEAT, PER))
def _(spark, d):
    return structure.group_effects(features(spark, d), B.note_funnel(spark, d), "style", "k", ["views", "clicks", "orders", "gmv"])


@query("feature_interaction", "SELECT style, angle, count(DISTINCT k) AS notes, avg(views) AS avg_views FROM ft LEFT JOIN nf USING (k) GROUP BY ALL", "avg_views", T.with_(T.EVENTS, T.FUNNEL, FEAT))
def _(spark, d):
    return structure.interaction(features(spark, d), B.note_funnel(spark, d), ["style", "angle"], "k", "views")


@query("portfolio_mix", "SELECT category_l1, CAST(sum(paid_orders) AS BIGINT) AS paid_orders, sum(gmv) AS gmv, sum(paid_orders) / sum(sum(paid_orders)) OVER () AS paid_orders_share, sum(gmv) / sum(sum(gmv)) OVER () AS gmv_share FROM spp GROUP BY ALL", "gmv paid_orders_share gmv_share", SP)
def _(spark, d):
    return structure.share_of(perf(spark, d), [], ["category_l1"], ["paid_orders", "gmv"])


@query("explicit_link_probe", "SELECT count(*) AS linked_skus FROM part WHERE p_partkey IN (SELECT sku_id FROM ol WHERE priority = '1-URGENT')", "", OL)
def _(spark, d):
    return B.products(spark, d).join(B.anchors(spark, d), "sku_id", "left_semi").agg(F.count("*").alias("linked_skus"))


# Carriers and channels

WIDE = "wd AS (SELECT shop_id, day, sum(paid_amount) FILTER (carrier = 'F') AS F_gmv, count(*) FILTER (carrier = 'F') AS F_orders, sum(paid_amount) FILTER (carrier = 'O') AS O_gmv, count(*) FILTER (carrier = 'O') AS O_orders FROM ol GROUP BY ALL)"


@query("carrier_unpivot", "SELECT shop_id, day, 'F' AS carrier, F_gmv AS gmv, F_orders AS orders FROM wd UNION ALL SELECT shop_id, day, 'O', O_gmv, O_orders FROM wd", "gmv", T.with_(T.ORDER_LINES, WIDE))
def _(spark, d):
    side = lambda c: [F.sum(F.when(F.col("carrier") == c, F.col("paid_amount"))).alias(f"{c}_gmv"), F.count_if(F.col("carrier") == c).alias(f"{c}_orders")]
    return structure.unpivot_groups(lines(spark, d).groupBy("shop_id", "day").agg(*side("F"), *side("O")), ["shop_id", "day"], ["F", "O"], ["gmv", "orders"])


@query("carrier_structure", "SELECT shop_id, carrier, sum(paid_amount) AS gmv, sum(quantity) AS units, sum(paid_amount) / sum(sum(paid_amount)) OVER (PARTITION BY shop_id) AS gmv_share, sum(quantity) / sum(sum(quantity)) OVER (PARTITION BY shop_id) AS units_share FROM ol GROUP BY shop_id, carrier", "gmv units gmv_share units_share", OL)
def _(spark, d):
    return structure.share_of(lines(spark, d).select("shop_id", "carrier", F.col("paid_amount").alias("gmv"), F.col("quantity").alias("units")), ["shop_id"], ["carrier"], ["gmv", "units"])


@query("channel_matrix", "SELECT shop_id, carrier, priority, sum(paid_amount) AS gmv, count(DISTINCT order_id) AS orders, count(DISTINCT buyer_id) AS buyers, sum(paid_amount) / count(DISTINCT buyer_id) AS gmv_per_buyer FROM ol GROUP BY ALL", "gmv gmv_per_buyer", OL)
def _(spark, d):
    s = lines(spark, d).groupBy("shop_id", "carrier", "priority").agg(F.sum("paid_amount").alias("gmv"), F.countDistinct("order_id").alias("orders"), F.countDistinct("buyer_id").alias("buyers"))
    return s.withColumn("gmv_per_buyer", C.ratio(F.col("gmv"), F.col("buyers")))


# Refunds


@query("refund_layers", "SELECT shop_id, carrier AS layer, sum(paid_amount) AS refund_amount, sum(paid_amount) / sum(sum(paid_amount)) OVER (PARTITION BY shop_id) AS share FROM ol WHERE refunded GROUP BY shop_id, carrier", "refund_amount share", OL)
def _(spark, d):
    return structure.share_of(lines(spark, d).where("refunded").select("shop_id", F.col("carrier").alias("layer"), F.col("paid_amount").alias("refund_amount")), ["shop_id"], ["layer"], ["refund_amount"]).withColumnRenamed("refund_amount_share", "share")


@query("refund_reasons", "SELECT reason, sum(paid_amount) AS refund_amount, count(DISTINCT order_id) AS refund_orders, sum(paid_amount) / sum(sum(paid_amount)) OVER () AS amount_share, count(DISTINCT order_id) / sum(count(DISTINCT order_id)) OVER () AS order_share FROM ol WHERE reason <> 'N' GROUP BY ALL", "refund_amount amount_share order_share", OL)
def _(spark, d):
    s = lines(spark, d).where("reason <> 'N'").groupBy("reason").agg(F.sum("paid_amount").alias("refund_amount"), F.countDistinct("order_id").alias("refund_orders"))
    total = s.agg(F.sum("refund_amount").alias("_a"), F.sum("refund_orders").alias("_o"))
    return s.crossJoin(F.broadcast(total)).select("reason", "refund_amount", "refund_orders", (F.col("refund_amount") / F.col("_a")).alias("amount_share"), (F.col("refund_orders") / F.col("_o")).alias("order_share"))  # one row


@query(
    "refund_carrier", f"SELECT carrier, n, refund_orders, refund_orders / n AS refund_rate, {T.wilson('refund_orders', 'n', True)} AS wilson_low, {T.wilson('refund_orders', 'n', False)} AS wilson_high, refund_amount FROM (SELECT carrier, count(DISTINCT order_id) AS n, count(DISTINCT CASE WHEN refunded THEN order_id END) AS refund_orders, sum(CASE WHEN refunded THEN paid_amount ELSE 0 END) AS refund_amount FROM ol GROUP BY ALL)",
    "refund_rate wilson_low wilson_high refund_amount", OL,
)
def _(spark, d):
    s = lines(spark, d).groupBy("carrier").agg(F.countDistinct("order_id").alias("n"), F.countDistinct(F.when(F.col("refunded"), F.col("order_id"))).alias("refund_orders"), F.sum(F.when(F.col("refunded"), F.col("paid_amount")).otherwise(0.0)).alias("refund_amount"))
    lo, hi = S.wilson(F.col("refund_orders"), F.col("n"))
    return s.select("carrier", "n", "refund_orders", (F.col("refund_orders") / F.col("n")).alias("refund_rate"), lo.alias("wilson_low"), hi.alias("wilson_high"), "refund_amount")


@query("product_refund", "SELECT category_l1, sku_id, sku_name, refund_amount, refund_amount / sum(refund_amount) OVER (PARTITION BY category_l1) AS amount_share, refund_orders / paid_orders AS refund_rate, row_number() OVER (PARTITION BY category_l1 ORDER BY refund_amount DESC, sku_id) <= 3 AS in_top3 FROM spp", "refund_amount amount_share refund_rate", SP)
def _(spark, d):
    rows = stored(perf(spark, d), "product-refund")
    whole = rows.groupBy("category_l1").agg(F.sum("refund_amount").alias("_whole"))
    top = top_rows(rows, ["category_l1"], [F.desc("refund_amount"), F.asc("sku_id")], 3).select("sku_id", F.lit(True).alias("_top"))
    marked = with_group(rows.join(top, "sku_id", "left"), whole, ["category_l1"])
    share, rate = C.ratio(F.col("refund_amount"), F.col("_whole")), C.ratio(F.col("refund_orders"), F.col("paid_orders"))
    shown = ("category_l1", "sku_id", "sku_name", "refund_amount")
    return marked.select(*shown, share.alias("amount_share"), rate.alias("refund_rate"), F.coalesce("_top", F.lit(False)).alias("in_top3"))


# Search and funnels


@query("search_funnel", "SELECT k % 10 AS term, CAST(CASE WHEN views > 20 THEN clicks ELSE views * 0.5 END AS DOUBLE) AS click_users, CASE WHEN views > 20 THEN 'real' ELSE 'forward_derived' END AS click_source, k FROM nf", "click_users", NF)
def _(spark, d):
    observed = F.when(F.col("views") > 20, F.col("clicks")).cast("double")
    users, source = structure.observed_or_derived(observed, F.col("views").cast("double"), F.lit(0.5))
    return B.note_funnel(spark, d).select((F.col("k") % 10).alias("term"), users.alias("click_users"), source.alias("click_source"), "k")


@query(
    "search_term_class",
    f"""SELECT k, views, orders, baseline, CASE WHEN views > 0 THEN {T.clamp('orders', 'views')} / views END AS rate, wilson_low, wilson_high, CASE WHEN views <= 0 THEN 'not_judgable' WHEN views < 30 THEN 'small_sample' WHEN wilson_low > baseline THEN 'opportunity' WHEN wilson_high < baseline THEN 'leak' ELSE 'average' END AS term_class
    FROM (SELECT *, sum(orders) OVER () / sum(views) OVER () AS baseline, {T.wilson('orders', 'views', True)} AS wilson_low, {T.wilson('orders', 'views', False)} AS wilson_high FROM nf)""",
    "baseline rate wilson_low wilson_high", NF,
)
def _(spark, d):
    return structure.term_classes(B.note_funnel(spark, d), "k", "views", "orders")


@query("search_trend", "SELECT *, CASE WHEN b <> 0 THEN (rate - b) / b END AS pct FROM (SELECT day, purchases / views AS rate, lag(purchases / views) OVER (ORDER BY day) AS b FROM (SELECT day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases FROM ev GROUP BY day) WHERE views > 0)", "rate b pct", EV)
def _(spark, d):
    days = B.traffic(spark, d).groupBy("day").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("purchases")).where("views > 0")
    rows = series.mom_change(days.select("day", (F.col("purchases") / F.col("views")).alias("rate")), [], "day", "rate")
    return rows.select("day", "rate", (F.col("rate") - F.col("delta")).alias("b"), "pct")


STAGES = [("views", "clicks"), ("clicks", "carts"), ("carts", "orders")]
STAGE_SQL = " UNION ALL ".join(f"SELECT g, '{a}_to_{b}' AS funnel_stage, CAST({a} AS DOUBLE) AS denominator, CASE WHEN {a} > 0 THEN {T.clamp(b, a)} / {a} END AS rate, {T.wilson(b, a, True)} AS ci_low, {T.wilson(b, a, False)} AS ci_high FROM f" for a, b in STAGES)


@query("store_funnel", f"SELECT *, denominator >= 30 AND row_number() OVER (PARTITION BY g ORDER BY CASE WHEN denominator >= 30 THEN rate END NULLS LAST, funnel_stage) = 1 AS is_weakest FROM ({STAGE_SQL})", "denominator rate ci_low ci_high", T.with_(T.EVENTS, T.FUNNEL, "f AS (SELECT k % 10 AS g, CAST(sum(views) AS BIGINT) AS views, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(carts) AS BIGINT) AS carts, CAST(sum(orders) AS BIGINT) AS orders FROM nf GROUP BY ALL)"))
def _(spark, d):
    return structure.stage_rates(B.note_funnel(spark, d).withColumn("g", F.col("k") % 10), ["g"], ["views", "clicks", "carts", "orders"])


@query("audience_scope", "SELECT g, cycle, users FROM (SELECT *, max(d) OVER (PARTITION BY g) AS m FROM (SELECT g, d || ' days' AS cycle, d, count(DISTINCT user_id) AS users FROM (SELECT user_id % 7 AS g, unnest(CASE WHEN user_id % 2 = 0 THEN [180, 365] ELSE [180] END) AS d, user_id FROM ev) GROUP BY ALL)) WHERE d = m", "", EV)
def _(spark, d):
    cycles = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("180 days"), F.lit("365 days"))).otherwise(F.array(F.lit("180 days")))
    rows = B.traffic(spark, d).select((F.col("user_id") % 7).alias("g"), F.explode(cycles).alias("cycle"), "user_id").groupBy("g", "cycle").agg(F.countDistinct("user_id").alias("users"))
    return structure.widest_window(rows.unionByName(rows.groupBy("g").agg(F.sum("users").alias("users")).withColumn("cycle", F.lit("all"))), ["g"], "cycle", "all")


@query("cycle_collapse", """SELECT shop_id, state, min(period_month) AS "first", max(period_month) AS "last", count(*) AS rows, string_agg(DISTINCT period_month, ',' ORDER BY period_month) AS labels FROM (SELECT *, sum(c) OVER (PARTITION BY shop_id ORDER BY period_month) AS island FROM (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS c FROM (SELECT *, CASE WHEN gmv > lag(gmv) OVER w THEN 'up' ELSE 'down' END AS state FROM sm WINDOW w AS (PARTITION BY shop_id ORDER BY period_month)) WINDOW w AS (PARTITION BY shop_id ORDER BY period_month))) GROUP BY shop_id, state, island""", "", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH))
def _(spark, d):
    from tallyforge.plans.catalogue import monthly

    rows = series.mom_change(monthly(spark, d), ["shop_id"], "period_month", "gmv").withColumn("state", F.when(F.col("delta") > 0, "up").otherwise("down"))
    return series.islands(rows, ["shop_id"], "period_month", ["state"], "period_month")


@query("person_days", "SELECT CAST(sum(users) AS BIGINT) AS person_days, avg(users) AS daily_mean, (SELECT count(DISTINCT user_id) FROM ev WHERE event_type = 'view') AS unique_users FROM (SELECT day, count(DISTINCT user_id) AS users FROM ev WHERE event_type = 'view' GROUP BY day)", "daily_mean", EV)
def _(spark, d):
    views = B.traffic(spark, d).where("event_type = 'view'")
    days = views.groupBy("day").agg(F.countDistinct("user_id").alias("users")).agg(F.sum("users").alias("person_days"), F.avg("users").alias("daily_mean"))
    return days.crossJoin(F.broadcast(views.agg(F.countDistinct("user_id").alias("unique_users"))))  # one row each


@query("demand_funnel", "SELECT day, users_cart, users_paid, CASE WHEN users_cart > 0 THEN users_paid / users_cart END AS cart_to_pay FROM (SELECT day, count(DISTINCT user_id) FILTER (event_type = 'signup') AS users_cart, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS users_paid FROM ev GROUP BY day)", "cart_to_pay", EV)
def _(spark, d):
    users = lambda e: F.countDistinct(F.when(F.col("event_type") == e, F.col("user_id")))
    s = B.traffic(spark, d).groupBy("day").agg(users("signup").alias("users_cart"), users("purchase").alias("users_paid"))
    return s.withColumn("cart_to_pay", C.ratio(F.col("users_paid"), F.col("users_cart")))


# Bridges

MONTHS = """bm AS (SELECT shop_id, strftime(day, '%Y-%m') AS period_month, CAST(count(DISTINCT order_id) AS DOUBLE) AS v, CAST(count(DISTINCT buyer_id) AS DOUBLE) AS b, sum(paid_amount) AS g FROM ol GROUP BY ALL),
 bl AS (SELECT shop_id, period_month, v, b / v AS c, g / b AS a, lag(v) OVER w AS v0, lag(b / v) OVER w AS c0, lag(g / b) OVER w AS a0 FROM bm WINDOW w AS (PARTITION BY shop_id ORDER BY period_month)),
 bw AS (SELECT *, v * c * a AS g1, v0 * c0 * a0 AS g0, CASE WHEN abs(v * c * a - v0 * c0 * a0) < 1e-9 THEN g0 ELSE (g1 - g0) / (ln(g1) - ln(g0)) END AS w FROM bl WHERE v0 IS NOT NULL),
 br AS (SELECT shop_id, period_month, g1 - g0 AS delta_gmv, w * ln(v / v0) AS contrib_traffic, w * ln(c / c0) AS contrib_conversion, w * ln(a / a0) AS contrib_aov FROM bw)"""
DOM = "CASE WHEN abs(contrib_traffic) >= abs(contrib_conversion) AND abs(contrib_traffic) >= abs(contrib_aov) THEN 'traffic' WHEN abs(contrib_conversion) >= abs(contrib_aov) THEN 'conversion' ELSE 'aov' END"
BRIDGE = T.with_(T.ORDER_LINES, MONTHS)


def bridged(spark, d):
    """Orders stand for visitors: the star schema has none by shop."""
    rows = lines(spark, d).groupBy("shop_id", F.date_format("day", "yyyy-MM").alias("period_month")).agg(F.countDistinct("order_id").alias("visitors"), F.countDistinct("buyer_id").alias("buyers"), F.sum("paid_amount").alias("gmv"))
    return bridge.gmv_bridge(rows, ["shop_id"], "period_month")


@query("gmv_bridge", f"SELECT *, round(delta_gmv - contrib_traffic - contrib_conversion - contrib_aov, 3) AS residual, {DOM} AS dominant_factor, false AS partial FROM br", "delta_gmv contrib_traffic contrib_conversion contrib_aov residual", BRIDGE, digits=3)
def _(spark, d):
    return bridged(spark, d)


@query(
    "bridge_shares",
    f"""SELECT shop_id, period_month, factor, contribution, abs(contribution) / (abs(contrib_traffic) + abs(contrib_conversion) + abs(contrib_aov)) AS movement_share, factor = dom AS is_dominant, greatest(contrib_traffic, contrib_conversion, contrib_aov) > 0 AND least(contrib_traffic, contrib_conversion, contrib_aov) < 0 AS offsetting
    FROM (SELECT *, {DOM} AS dom, unnest(['traffic', 'conversion', 'aov']) AS factor, unnest([contrib_traffic, contrib_conversion, contrib_aov]) AS contribution FROM br)""",
    "contribution movement_share", BRIDGE, digits=3,
)
def _(spark, d):
    return bridge.bridge_shares(bridged(spark, d), ["shop_id"], "period_month")


@query("ledger", "SELECT shop_id, unnest(['conversion_ceiling', 'order_value_ceiling', 'refund_pool']) AS lever, unnest([c, a, r]) AS amount FROM (SELECT shop_id, sum(CASE WHEN contrib_conversion < 0 THEN -contrib_conversion ELSE 0 END) AS c, sum(CASE WHEN contrib_aov < 0 THEN -contrib_aov ELSE 0 END) AS a FROM br GROUP BY ALL) JOIN (SELECT shop_id, sum(paid_amount) AS r FROM ol WHERE refunded GROUP BY ALL) USING (shop_id)", "amount", BRIDGE, digits=3)
def _(spark, d):
    return bridge.ledger(bridged(spark, d), daily(spark, d), ["shop_id"])


# Paid traffic

ADS = """ad AS (SELECT l_suppkey AS supplier, s_nationkey AS nation, n_regionkey AS region, CAST(l_shipdate AS DATE) AS day, l_extendedprice * l_tax AS spend, CAST(l_quantity * 10 AS BIGINT) AS impressions, CAST(l_quantity AS BIGINT) AS clicks, 1::BIGINT AS orders, CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_extendedprice * (1 - l_discount) * 0.05 END AS gmv
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
RATIOS = "clicks / impressions AS ctr_calc, spend / impressions * 1000 AS cpm_calc, spend / clicks AS cpc_calc, orders / clicks AS order_rate_calc, spend / orders AS cpo_calc, gmv / spend AS roas_calc"
RATIO_NAMES = "spend gmv ctr_calc cpm_calc cpc_calc order_rate_calc cpo_calc roas_calc"
SUMS = "sum(spend) AS spend, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(orders) AS BIGINT) AS orders, sum(gmv) AS gmv"


@mart
def ads(spark, d):
    rows = B.table(spark, d, "lineitem").join(B.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(B.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    gmv = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 0.05)
    return rows.select(F.col("l_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") * F.col("l_tax")).alias("spend"), (F.col("l_quantity") * 10).cast("long").alias("impressions"), F.col("l_quantity").cast("long").alias("clicks"), F.lit(1).cast("long").alias("orders"), gmv.alias("gmv"))


@query("paid_efficiency", f"SELECT *, {RATIOS} FROM (SELECT supplier, count(DISTINCT day) AS paid_active_days, {SUMS} FROM ad GROUP BY ALL)", RATIO_NAMES, T.with_(ADS), digits=2)
def _(spark, d):
    return paid.efficiency(ads(spark, d), ["supplier"])


LEVELS = " UNION ALL ".join(f"SELECT '{x}' AS level, CAST({x} AS VARCHAR) AS object_id, {SUMS} FROM ad GROUP BY ALL" for x in ("region", "nation", "supplier"))


@query("paid_hierarchy", f"SELECT *, {RATIOS} FROM (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY spend DESC, object_id) AS r FROM ({LEVELS})) WHERE r <= 20)", RATIO_NAMES, T.with_(ADS), digits=2)
def _(spark, d):
    return paid.hierarchy(ads(spark, d), ["region", "nation", "supplier"])


@query("budget_action", "SELECT supplier, spend, roas, CASE WHEN clicks < 20 OR days < 2 THEN 'hold' WHEN spend >= 100 AND roas >= 3 THEN 'increase' WHEN spend >= 100 AND roas < 1 THEN 'reduce' ELSE 'hold' END AS action FROM (SELECT supplier, count(DISTINCT day) AS days, sum(clicks) AS clicks, sum(spend) AS spend, sum(gmv) / sum(spend) AS roas FROM ad GROUP BY ALL)", "spend roas", T.with_(ADS))
def _(spark, d):
    c = F.col
    return paid.efficiency(ads(spark, d), ["supplier"]).select("supplier", "spend", c("roas_calc").alias("roas"), paid.budget_action(c("spend"), c("clicks"), c("gmv"), c("roas_calc"), c("paid_active_days")).alias("action"))


@query(
    "spend_response",
    """SELECT * EXCLUDE (pg, ps), coalesce(bin = min(CASE WHEN marginal_roas < 1 THEN bin END) OVER (), false) AS is_saturation FROM (SELECT *, CASE WHEN avg_spend - ps > 0 THEN (avg_gmv - pg) / (avg_spend - ps) END AS marginal_roas FROM (
    SELECT bin, n, avg_spend, avg_gmv, avg_roas, lag(avg_gmv) OVER (ORDER BY bin) AS pg, lag(avg_spend) OVER (ORDER BY bin) AS ps FROM (SELECT CAST(greatest(len(list_filter(e, lambda x: spend >= x)) - 1, 0) AS BIGINT) AS bin, count(*) AS n, avg(spend) AS avg_spend, avg(gmv) AS avg_gmv, sum(gmv) / sum(spend) AS avg_roas FROM sg, se GROUP BY ALL)))""",
    "avg_spend avg_gmv avg_roas marginal_roas", T.with_(ADS, "sg AS (SELECT supplier, sum(spend) AS spend, sum(gmv) AS gmv FROM ad GROUP BY ALL)", "se AS (SELECT [min(spend), quantile_cont(spend, 0.25), quantile_cont(spend, 0.5), quantile_cont(spend, 0.75)] AS e FROM sg)"),
)
def _(spark, d):
    return paid.spend_response(ads(spark, d).groupBy("supplier").agg(F.sum("spend").alias("spend"), F.sum("gmv").alias("gmv")))


# Content


@query(
    "posting_windows",
    """SELECT weekday, slot, count(*) AS posts, avg(x) AS mean_value, avg(x) - any_value(gm) AS perf_lift FROM (SELECT *, avg(x) OVER () AS gm FROM (SELECT weekday, slot, value - (regr_intercept(value, o) OVER () + regr_slope(value, o) OVER () * o) + avg(value) OVER () AS x, count(*) OVER (PARTITION BY weekday, slot) AS n FROM (
    SELECT CAST(isodow(ts) AS INTEGER) AS weekday, CASE WHEN hour(ts) >= 5 AND hour(ts) < 11 THEN 'morning' WHEN hour(ts) >= 11 AND hour(ts) < 14 THEN 'noon' WHEN hour(ts) >= 14 AND hour(ts) < 18 THEN 'afternoon' WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 'evening' ELSE 'night' END AS slot, CAST(day - DATE '1970-01-01' AS DOUBLE) AS o, value FROM ev WHERE event_type = 'purchase')) WHERE n >= 3) GROUP BY weekday, slot""",
    "mean_value perf_lift", EV,
)
def _(spark, d):
    from tallyforge.operators.cadence import posting_windows

    rows = B.traffic(spark, d).where("event_type = 'purchase'").select((F.weekday("ts") + 1).alias("weekday"), C.day_part(F.hour("ts")).alias("slot"), F.unix_date("day").cast("double").alias("order"), "value")
    return posting_windows(rows, ["weekday", "slot"], "order", "value")


@query("note_conversion_outliers", f"SELECT k, views, orders, low FROM (SELECT k, views, orders, {T.wilson('orders', 'views', True)} AS low, sum(orders) OVER () / sum(views) OVER () AS base FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY views DESC, k) AS r, ceil(count(*) OVER () * 0.25) AS q FROM nf) WHERE r <= q)) WHERE low > base", "low", NF)
def _(spark, d):
    from tallyforge.operators.ranks import global_rank

    notes = global_rank(B.note_funnel(spark, d), [F.desc("views"), F.asc("k")])
    top = notes.crossJoin(F.broadcast(notes.agg(F.ceil(F.count("*") * 0.25).alias("q")))).where("rank <= q")  # one row
    base = top.agg((F.sum("orders") / F.sum("views")).alias("base"))
    low, _ = S.wilson(F.col("orders"), F.col("views"))
    return top.withColumn("low", low).crossJoin(F.broadcast(base)).where("low > base").select("k", "views", "orders", "low")  # one row


@query("referral", "SELECT k, sum(value) FILTER (event_type = 'signup') AS referral_gmv, sum(value) FILTER (event_type = 'purchase') AS note_gmv FROM ev GROUP BY k", "referral_gmv note_gmv", EV)
def _(spark, d):
    part = lambda e: F.sum(F.when(F.col("event_type") == e, F.col("value")))
    return B.traffic(spark, d).groupBy("k").agg(part("signup").alias("referral_gmv"), part("purchase").alias("note_gmv"))


def _shown(c: str) -> str:
    """To one decimal, from six: digits that depend on the order of additions don't decide how a value halfway is rounded."""
    return f"CAST(round(CAST({c} AS DECIMAL(38, 6)), 1) AS DOUBLE) AS {c}"


OPPORTUNITY = ("units", "gmv", "units_per_active_day", "gmv_per_active_day", "inventory_cover_active_days")


@query("product_opportunity", f"SELECT * REPLACE ({', '.join(map(_shown, OPPORTUNITY))}) FROM (SELECT sku_id, units, gmv, active_days, units / active_days AS units_per_active_day, gmv / active_days AS gmv_per_active_day, inventory, inventory / (units / active_days) AS inventory_cover_active_days, CASE WHEN units IS NULL OR units <= 0 THEN 'needs_sales' WHEN inventory <= 0 THEN 'out_of_stock' WHEN inventory / (units / active_days) <= 7 THEN 'low_inventory' ELSE 'response_present' END AS opportunity_type FROM (SELECT p_partkey AS sku_id, (p_size * 7) % 50 AS inventory FROM part) FULL JOIN (SELECT sku_id, sum(quantity) AS units, sum(paid_amount) AS gmv, count(DISTINCT day) AS active_days FROM ol WHERE NOT refunded GROUP BY sku_id) USING (sku_id))", " ".join(OPPORTUNITY), OL, digits=1)
def _(spark, d):
    catalog = B.products(spark, d).select("sku_id", ((F.col("size") * 7) % 50).alias("inventory"))
    sold = lines(spark, d).where("NOT refunded").groupBy("sku_id").agg(F.sum("quantity").alias("units"), F.sum("paid_amount").alias("gmv"), F.countDistinct("day").alias("active_days"))
    found = structure.opportunities(catalog, sold, "sku_id")
    return found.select(*(F.expr(_shown(c)) if c in OPPORTUNITY else F.col(c) for c in found.columns))


@query("reshoot_rank", "SELECT k, views AS reads, carts AS collects, CASE WHEN views > 0 THEN carts / views END AS collect_rate, views / (views + 50.0) AS confidence_weight, CASE WHEN views > 0 THEN carts / (views + 50.0) END AS conservative_collect_rate, 1 - views / max(views) OVER () AS read_gap_to_max, CASE WHEN views > 0 THEN carts / (views + 50.0) * (2 - views / max(views) OVER ()) END AS opportunity_score FROM nf ORDER BY opportunity_score DESC NULLS LAST, collects DESC, k LIMIT 10", "collect_rate confidence_weight conservative_collect_rate read_gap_to_max opportunity_score", NF)
def _(spark, d):
    return structure.reshoot_score(B.note_funnel(spark, d).select("k", F.col("views").alias("reads"), F.col("carts").alias("collects")))


@query("experiment_plan", "SELECT DATE '2026-01-05' + CAST(s // 5 AS INTEGER) AS day, s // 5 AS day_index, s % 5 AS slot_index, sku_id, angle FROM range(35) t(s) JOIN (SELECT sku_id, row_number() OVER (ORDER BY gmv DESC, sku_id) - 1 AS pos FROM spp ORDER BY gmv DESC, sku_id LIMIT 4) x ON s % 4 = x.pos JOIN (VALUES ('daily', 0), ('gift', 1), ('story', 2)) a(angle, apos) ON (s // 5 + s % 5) % 3 = apos", "", SP)
def _(spark, d):
    from pyspark.sql import Window as W

    top = perf(spark, d).orderBy(F.desc("gmv"), "sku_id").limit(4)
    skus = top.select("sku_id", (F.row_number().over(W.orderBy(F.desc("gmv"), "sku_id")) - 1).alias("pos"))  # four rows
    angles = spark.createDataFrame([("daily", 0), ("gift", 1), ("story", 2)], "angle string, pos int")
    return structure.round_robin_plan(skus, angles, "2026-01-05")


# Text


@query("polarity", "SELECT conv_id, turn, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END AS polarity FROM (SELECT conv_id, turn, len(regexp_extract_all(text, 'the')) + len(regexp_extract_all(text, 'ing')) AS p, len(regexp_extract_all(text, 'er')) AS n FROM conversations WHERE role = 'user')", "polarity")
def _(spark, d):
    return B.comments(spark, d).select("conv_id", "turn", text.polarity(F.col("text"), ("the", "ing"), ("er",)).alias("polarity"))


GRAMS = """rn AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM (SELECT conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'user')),
 gr AS (SELECT id, substr(run, i, s) AS term FROM (SELECT id, run, s, unnest(range(1, length(run) - s + 2)) AS i FROM rn, (VALUES (2), (3), (4)) z(s) WHERE length(run) >= s)),
 kt AS (SELECT term, count(*) AS c, count(DISTINCT id) AS doc_count FROM gr GROUP BY term HAVING count(DISTINCT id) >= 2)"""


@query("themes", "SELECT term, c AS \"count\", doc_count, doc_count / n AS coverage, c * doc_count / n AS score FROM kt t, (SELECT count(DISTINCT conv_id || '-' || turn) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE NOT EXISTS (SELECT 1 FROM kt o WHERE o.doc_count = t.doc_count AND length(o.term) > length(t.term) AND contains(o.term, t.term)) ORDER BY score DESC, c DESC, term LIMIT 10", "coverage score", T.with_(GRAMS))
def _(spark, d):
    rows = B.comments(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return text.themes(rows, "id", "text")


@query("theme_trend", "SELECT turn, count(*) FILTER (contains(lower(text), 'tion')) AS doc_count FROM conversations WHERE role = 'user' GROUP BY turn")
def _(spark, d):
    return text.theme_periods(B.comments(spark, d), "turn", "text", "tion")


DEMAND = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in text.DEMAND)


@query("demand_groups", f"SELECT demand_group, count(*) AS comments, count(DISTINCT conv_id) AS notes, count(*) / sum(count(*)) OVER () AS comment_share, list_sort(list(text ORDER BY text, conv_id)[1:3]) AS examples FROM (SELECT *, CASE {DEMAND} ELSE 'other' END AS demand_group FROM conversations WHERE role = 'user') GROUP BY demand_group", "comment_share")
def _(spark, d):
    return text.demand_summary(B.comments(spark, d), "conv_id", "text")


HOOKS = " ".join(f"WHEN contains(lower(text), '{n}') THEN '{a}'" for n, a in sorted(text.HOOKS, key=lambda x: -len(x[0])))


@query("objection_hooks", f"SELECT conv_id, turn, CASE {HOOKS} END AS hook FROM conversations WHERE role = 'user'")
def _(spark, d):
    return B.comments(spark, d).select("conv_id", "turn", text.hook(F.col("text")).alias("hook"))
