"""Registered queries on findings: facts, validation, coverage, priority, hypotheses, the weekly review; and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.functions import statistics as S
from tallyforge.operators import compare, structure
from tallyforge.plans import facts
from tallyforge.plans import sqltext as T
from tallyforge.plans.catalogue import daily, lines, perf, query
from tallyforge.sources import bindings as B
from tallyforge.streaming import marts as stream
from tallyforge.streaming import partials, responses, sales

EV, OL, SD, SP = T.with_(T.EVENTS), T.with_(T.ORDER_LINES), T.with_(T.ORDER_LINES, T.SHOP_DAY), T.with_(T.ORDER_LINES, T.SKU_PERF)

KEY_NUMBERS = """kn AS (SELECT shop_id, 'core_business' AS task_id, unnest(['gmv', 'paid_orders', 'refund_rate_pay', 'avg_daily_aov']) AS metric_key, unnest([sum(gmv), CAST(sum(paid_orders) AS DOUBLE), sum(refund_amount) / sum(gmv), avg(gmv / paid_orders)]) AS value FROM sd GROUP BY shop_id
 UNION ALL SELECT shop_id, 'refund_structure', unnest(['refund_amount_pay', 'refund_rate_pay']), unnest([sum(refund_amount), sum(refund_amount) / sum(gmv)]) FROM sd GROUP BY shop_id)"""


def key_numbers(spark, d):
    rows = daily(spark, d)
    core = rows.groupBy("shop_id").agg(F.sum("gmv").alias("gmv"), F.sum("paid_orders").cast("double").alias("paid_orders"), (F.sum("refund_amount") / F.sum("gmv")).alias("refund_rate_pay"), F.avg(F.col("gmv") / F.col("paid_orders")).alias("avg_daily_aov"))
    refund = rows.groupBy("shop_id").agg(F.sum("refund_amount").alias("refund_amount_pay"), (F.sum("refund_amount") / F.sum("gmv")).alias("refund_rate_pay"))
    return facts.flatten(core, ["shop_id"], "core_business").unionByName(facts.flatten(refund, ["shop_id"], "refund_structure"))


KIND = """CASE WHEN regexp_matches(metric_key, '_observed_days$') THEN 'count' WHEN regexp_matches(metric_key, '_(buyer|visitor|user)_days$') THEN 'person_day'
 WHEN regexp_matches(metric_key, 'rate|share|pct') THEN 'percent' WHEN regexp_matches(metric_key, '_(hhi|gini)$') THEN 'index'
 WHEN regexp_matches(metric_key, 'gmv|amount|aov|spend') THEN 'money' ELSE 'count' END"""


@query("facts", f"SELECT shop_id, task_id, metric_key, value, CASE WHEN count(*) OVER (PARTITION BY shop_id, metric_key) > 1 THEN task_id || '.' || metric_key ELSE metric_key END AS fact_id, {KIND} AS unit FROM kn", "value", T.with_(T.ORDER_LINES, T.SHOP_DAY, KEY_NUMBERS))
def _(spark, d):
    return facts.identified(key_numbers(spark, d), ["shop_id"])


@query("fact_validation", f"SELECT metric_key, unit, count(*) AS facts, CASE WHEN ru IS NULL THEN 'unregistered' WHEN ru <> unit THEN 'unit' ELSE 'ok' END AS status FROM (SELECT *, {KIND} AS unit FROM kn) LEFT JOIN (VALUES ('gmv', 'money'), ('refund_rate_pay', 'percent'), ('refund_amount_pay', 'money'), ('avg_daily_aov', 'count')) r(mk, ru) ON mk = metric_key GROUP BY ALL", "", T.with_(T.ORDER_LINES, T.SHOP_DAY, KEY_NUMBERS))
def _(spark, d):
    registry = spark.createDataFrame([("gmv", "money"), ("refund_rate_pay", "percent"), ("refund_amount_pay", "money"), ("avg_daily_aov", "count")], "metric_key string, registered_unit string")
    return facts.validated(facts.identified(key_numbers(spark, d), ["shop_id"]), registry).groupBy("metric_key", "unit", "status").agg(F.count("*").alias("facts"))


@query("share_sums", "SELECT shop_id, abs(sum(s) - 1) <= 1e-6 AS sums_to_one FROM (SELECT shop_id, carrier, sum(paid_amount) / sum(sum(paid_amount)) OVER (PARTITION BY shop_id) AS s FROM ol GROUP BY shop_id, carrier) GROUP BY shop_id", "", OL)
def _(spark, d):
    shares = structure.share_of(lines(spark, d), ["shop_id"], ["carrier"], ["paid_amount"])
    return facts.must_sum_to(shares, ["shop_id"], "paid_amount_share", 1.0)


FINDINGS = f"""f0 AS (SELECT category_l1, CAST(sum(refund_orders) AS BIGINT) AS k, CAST(sum(paid_orders) AS BIGINT) AS n FROM spp GROUP BY ALL),
 fi AS (SELECT category_l1 AS task_id, unnest(['refund', 'sales']) AS lever, unnest([n >= 30, true]) AS judgable, unnest([0.9, 0.6]) AS evidence, unnest([CASE WHEN n >= 1000 THEN 1.0 ELSE 0.5 END, 0.5]) AS reliability, unnest([1.0, 0.8]) AS weight FROM f0)"""


def findings(spark, d):
    rows = perf(spark, d).groupBy("category_l1").agg(F.sum("paid_orders").alias("n"))
    levers = F.array(F.struct(F.lit("refund").alias("lever"), S.enough(F.col("n")).alias("judgable"), F.lit(0.9).alias("evidence"), F.when(F.col("n") >= 1000, 1.0).otherwise(0.5).alias("reliability")), F.struct(F.lit("sales").alias("lever"), F.lit(True).alias("judgable"), F.lit(0.6).alias("evidence"), F.lit(0.5).alias("reliability")))
    return rows.select(F.col("category_l1").alias("task_id"), F.inline(levers))


@query("coverage", "SELECT task_id, bool_or(judgable) AS producible, count(*) FILTER (judgable) AS judgable_findings FROM fi GROUP BY ALL", "", T.with_(T.ORDER_LINES, T.SKU_PERF, FINDINGS))
def _(spark, d):
    return facts.coverage(findings(spark, d), ["task_id"])


@query("priority", "SELECT task_id, lever, score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, lever) AS r FROM (SELECT task_id, lever, CAST(weight * (0.6 * evidence + 0.4 * reliability) AS DOUBLE) AS score FROM fi WHERE judgable)) WHERE r = 1 ORDER BY score DESC, task_id LIMIT 5", "score", T.with_(T.ORDER_LINES, T.SKU_PERF, FINDINGS))
def _(spark, d):
    weights = spark.createDataFrame([("refund", 1.0), ("sales", 0.8)], "lever string, weight double")
    return facts.priority(findings(spark, d), weights, [], 5)


@query(
    "fact_hash",
    "SELECT shop_id, sha256(CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', task_id, CASE WHEN several > 1 THEN task_id || '.' || metric_key ELSE metric_key END, printf('%.1f', value))), 1, 14) AS BIGINT)) AS VARCHAR)) AS content_hash FROM (SELECT *, count(*) OVER (PARTITION BY shop_id, metric_key) AS several FROM kn) GROUP BY shop_id",
    "", T.with_(T.ORDER_LINES, T.SHOP_DAY, KEY_NUMBERS),
)
def _(spark, d):
    return facts.content_hash(facts.identified(key_numbers(spark, d), ["shop_id"]), ["shop_id"], 1)


@query(
    "hypotheses",
    "SELECT 'h_' || substr(sha1(seed), 1, 10) AS hypothesis_id, theme, label, evidence_count FROM (SELECT 'sku:' || sku_id AS seed, 'sku' AS theme, CAST(sku_id AS VARCHAR) AS label, paid_orders AS evidence_count FROM (SELECT * FROM spp ORDER BY gmv DESC, sku_id LIMIT 1) UNION ALL SELECT 'category:' || category_l1, 'category', category_l1, n FROM (SELECT category_l1, CAST(sum(paid_orders) AS BIGINT) AS n FROM spp GROUP BY ALL ORDER BY n DESC, category_l1 LIMIT 1))",
    "", SP,
)
def _(spark, d):
    p = perf(spark, d)
    sku = p.orderBy(F.desc("gmv"), "sku_id").limit(1).select(F.lit("sku").alias("theme"), F.col("sku_id").cast("string").alias("label"), F.col("paid_orders").alias("evidence_count"))
    cat = p.groupBy("category_l1").agg(F.sum("paid_orders").alias("n")).orderBy(F.desc("n"), "category_l1").limit(1).select(F.lit("category").alias("theme"), F.col("category_l1").alias("label"), F.col("n").alias("evidence_count"))
    rows = sku.unionByName(cat)
    return rows.select(C.stable_id(F.concat_ws(":", "theme", "label")).alias("hypothesis_id"), "theme", "label", "evidence_count")


@query(
    "weekly_review",
    "SELECT 'sales' AS section, 'gmv' AS metric, sum(gmv) AS value, count(*) AS evidence_count FROM sd UNION ALL SELECT 'sales', 'refund_rate', avg(CASE WHEN gmv > 0 THEN refund_amount / gmv END), count(*) FROM sd UNION ALL SELECT 'traffic', 'views', CAST(count(*) AS DOUBLE), count(*) FROM ev WHERE event_type = 'view' UNION ALL SELECT 'comments', 'comments', CAST(count(*) AS DOUBLE), count(*) FROM conversations WHERE role = 'user'",
    "value", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.EVENTS),
)
def _(spark, d):
    days = daily(spark, d)
    row = lambda df, section, metric, value: df.agg(value.cast("double").alias("value"), F.count("*").alias("evidence_count")).select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "value", "evidence_count")
    return (
        row(days, "sales", "gmv", F.sum("gmv")).unionByName(row(days, "sales", "refund_rate", F.avg(C.ratio(F.col("refund_amount"), F.col("gmv")))))
        .unionByName(row(B.traffic(spark, d).where("event_type = 'view'"), "traffic", "views", F.count("*"))).unionByName(row(B.comments(spark, d), "comments", "comments", F.count("*")))
    )


@query("account_baseline", "SELECT day, count(*) AS posts, avg(value) AS avg_value FROM ev WHERE event_type = 'view' GROUP BY day", "avg_value", EV)
def _(spark, d):
    return B.traffic(spark, d).where("event_type = 'view'").groupBy("day").agg(F.count("*").alias("posts"), F.avg("value").alias("avg_value"))


@query("ad_quality", "SELECT count(*) AS rows, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date, sum(l_extendedprice * l_tax) AS total_spend, true AS has_click_metrics, count(l_partkey) AS sku_link_rows, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS gmv_rows FROM lineitem", "total_spend")
def _(spark, d):
    t = B.table(spark, d, "lineitem")
    return t.agg(F.count("*").alias("rows"), F.min(F.col("l_shipdate").cast("date")).alias("first_date"), F.max(F.col("l_shipdate").cast("date")).alias("last_date"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("total_spend"), F.lit("l_quantity" in t.columns).alias("has_click_metrics"), F.count("l_partkey").alias("sku_link_rows"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("gmv_rows"))


@query("source_structure", "SELECT carrier, priority, CAST(sum(quantity) AS DOUBLE) AS visitors, sum(quantity) / sum(sum(quantity)) OVER (PARTITION BY carrier) AS visitors_share, sum(paid_amount) AS gmv, sum(paid_amount) / sum(sum(paid_amount)) OVER (PARTITION BY carrier) AS gmv_share FROM ol GROUP BY carrier, priority", "visitors visitors_share gmv gmv_share", OL)
def _(spark, d):
    return structure.share_of(lines(spark, d).select("carrier", "priority", F.col("quantity").alias("visitors"), F.col("paid_amount").alias("gmv")), ["carrier"], ["priority"], ["visitors", "gmv"])


@query("audience_value", "SELECT segment, count(*) AS buyers, sum(gmv) AS gmv, sum(gmv) / sum(sum(gmv)) OVER () AS gmv_share FROM (SELECT buyer_id, CASE WHEN count(DISTINCT order_id) = 1 THEN 'first' WHEN count(DISTINCT order_id) <= 10 THEN 'repeat' ELSE 'loyal' END AS segment, sum(paid_amount) AS gmv FROM ol GROUP BY buyer_id) GROUP BY segment", "gmv gmv_share", OL)
def _(spark, d):
    orders = F.countDistinct("order_id")
    buyers = lines(spark, d).groupBy("buyer_id").agg(F.when(orders == 1, "first").when(orders <= 10, "repeat").otherwise("loyal").alias("segment"), F.sum("paid_amount").alias("gmv"), F.lit(1).alias("buyers"))
    return structure.share_of(buyers, [], ["segment"], ["buyers", "gmv"]).drop("buyers_share")


@query("category_l2", "SELECT category_l2, sum(gmv) AS gmv, sum(gmv) / sum(sum(gmv)) OVER () AS gmv_share, CAST(sum(paid_orders) AS BIGINT) AS paid_orders, CASE WHEN sum(paid_orders) >= 10 THEN sum(refund_orders) / sum(paid_orders) END AS refund_rate, row_number() OVER (ORDER BY sum(gmv) DESC, category_l2) AS gmv_rank, row_number() OVER (ORDER BY CASE WHEN sum(paid_orders) >= 10 THEN sum(refund_orders) / sum(paid_orders) END DESC NULLS LAST, category_l2) AS refund_rank FROM spp GROUP BY category_l2", "gmv gmv_share refund_rate", SP)
def _(spark, d):
    from pyspark.sql import Window as W

    s = structure.share_of(perf(spark, d), [], ["category_l2"], ["gmv", "paid_orders", "refund_orders"])
    rate = F.when(F.col("paid_orders") >= 10, F.col("refund_orders") / F.col("paid_orders"))
    place = lambda c: F.row_number().over(W.orderBy(c, "category_l2")).cast("long")  # noqa: E731  one row for each category
    return s.withColumn("refund_rate", rate).select("category_l2", "gmv", "gmv_share", "paid_orders", "refund_rate", place(F.desc("gmv")).alias("gmv_rank"), place(F.desc_nulls_last("refund_rate")).alias("refund_rank"))


@query("fdr_families", "SELECT shop_id, count(*) AS tested, CAST(sum(CASE WHEN fdr_significant THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM (SELECT shop_id, rk <= coalesce(max(CASE WHEN p <= rk / m * 0.05 THEN rk END) OVER (PARTITION BY shop_id), 0) AS fdr_significant FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY p, buyer_id) AS rk, count(*) OVER (PARTITION BY shop_id) AS m FROM (SELECT shop_id, buyer_id, " + T.binomial_p("k", "n", "base") + " AS p FROM (SELECT *, sum(k) OVER (PARTITION BY shop_id) / sum(n) OVER (PARTITION BY shop_id) AS base FROM (SELECT shop_id, buyer_id, count(*) AS n, count(*) FILTER (refunded) AS k FROM ol GROUP BY ALL))))) GROUP BY shop_id", "", OL)
def _(spark, d):
    rows = lines(spark, d).groupBy("shop_id", "buyer_id").agg(F.count("*").alias("n"), F.count_if("refunded").alias("k"))
    base = rows.groupBy("shop_id").agg((F.sum("k") / F.sum("n")).alias("base"))
    tested = rows.join(base, "shop_id").withColumn("p", S.one_sided_binomial_p(F.col("k"), F.col("n"), F.col("base")))
    return compare.false_discovery(tested, ["shop_id"], "p", "buyer_id").groupBy("shop_id").agg(F.count("*").alias("tested"), F.count_if("fdr_significant").alias("flagged"))


# Streams


def _stream(spark, d):
    """The path is a pattern, as a stream takes no single file."""
    return stream.events_stream(spark, f"{d}/event[s].parquet", spark.read.parquet(f"{d}/events.parquet").schema)


@query("stream_daily_sales", "SELECT day, event_type, k, count(*) AS events, sum(value) AS amount FROM ev GROUP BY ALL", "amount", EV)
def _(spark, d):
    folder = stream.run_available(stream.daily_sales(_stream(spark, d), late="400 days"), "daily", "update", stream.append_epoch)
    return stream.latest(spark, folder, ["day", "event_type", "k"])


@query(
    "stream_merge",
    "SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) FILTER (value IS NOT NULL) AS value FROM ev GROUP BY user_id",
    "value",
    EV,
)
def _(spark, d):
    rows = _stream(spark, d).select("user_id", "event_id", "value")
    folder = stream.run_available(rows, "merge", "append", partials.merge_epoch(["user_id"], "event_id"))
    return partials.merged(spark, folder, ["user_id"], "event_id", ["value"])


@query(
    "stream_conflicts",
    "SELECT user_id, event_type, 'value' AS conflict FROM ev GROUP BY user_id, event_type HAVING count(DISTINCT value) > 1",
    "",
    EV,
)
def _(spark, d):
    keys = ["user_id", "event_type"]
    rows = _stream(spark, d).select(*keys, "event_id", "value")
    folder = stream.run_available(rows, "conflicts", "append", partials.merge_epoch(keys, "event_id"))
    return partials.conflicts(spark, folder, keys, "event_id", ["value"])


@query(
    "stream_sku_days",
    "SELECT shop_id, day, sku_id, units, gmv, order_count, day < (SELECT max(day) FROM daily_all) - 3 AS final FROM daily",
    "units gmv",
    T.with_(T.ORDER_LINES, T.DAILY_SKU, "daily_all AS (SELECT day FROM ol WHERE NOT refunded)"),
)
def _(spark, d):
    """Order lines in order of their days, in slices of a year or less; three days of lateness."""
    sold = lines(spark, d).where("NOT refunded").select(
        "shop_id", "day", "sku_id", "order_id", F.col("quantity").alias("units"), F.col("paid_amount").alias("gmv")
    )
    folder = stream.run_available(stream.replayed(sold, "day", "sales"), "sales", "append", sales.sales_epoch(3))
    return sales.sku_days(spark, folder)


FAR = "2999-01-01"
#: Rows of a slice of stream_response_windows, about; its epochs hold them on disk, not in state stores.
RESPONSE_SLICE = 10_000_000


@query(
    "stream_response_windows",
    """SELECT shop_id, note_id, sku_id, publish_day, coalesce(sum(units) FILTER (g >= 0 AND g < 1), 0.0) AS d0_1_units,
      coalesce(sum(units) FILTER (g >= 1 AND g < 4), 0.0) AS d1_3_units, coalesce(sum(units) FILTER (g >= 4 AND g < 8), 0.0) AS d4_7_units,
      coalesce(sum(units) FILTER (g >= 8 AND g < 15), 0.0) AS d8_14_units, count(DISTINCT g) FILTER (g >= 0 AND g < 15) AS matched_sales_days
      FROM (SELECT a.*, units, day - publish_day AS g FROM anchors a LEFT JOIN daily USING (shop_id, sku_id)) GROUP BY shop_id, note_id, sku_id, publish_day""",
    "d0_1_units d1_3_units d4_7_units d8_14_units",
    T.with_(T.ORDER_LINES, T.DAILY_SKU, "anchors AS (SELECT shop_id, order_id || '-' || line AS note_id, sku_id, day AS publish_day FROM ol WHERE priority = '1-URGENT')"),
)
def _(spark, d):
    """Order lines in order of their days, in slices of a year or less. The last row of the replay is far ahead, so that all windows before it close."""
    note = F.when(F.col("priority") == "1-URGENT", F.concat_ws("-", "order_id", "line"))
    kept = lines(spark, d).select("shop_id", "sku_id", note.alias("note_id"), "day", F.col("quantity").alias("units"), F.coalesce(~F.col("refunded"), F.lit(False)).alias("sold")).where("note_id IS NOT NULL OR sold")
    far = lambda rows: rows.limit(1).withColumns({"shop_id": F.lit(-1).cast("long"), "day": F.lit(FAR).cast("date")})
    rows = stream.replayed(kept, "day", "responses", last=far, most=RESPONSE_SLICE)
    folder = stream.run_available(rows, "responses", "append", responses.responses_epoch(["shop_id", "sku_id"], 3))
    return responses.sent(spark, folder).select("shop_id", "note_id", "sku_id", F.col("day").alias("publish_day"), *(f"{w}_units" for w in responses.WINDOWS), "matched_sales_days")


@query("stream_response", "SELECT p.event_id, c.event_id AS click_id FROM ev p JOIN ev c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click'", "", EV)
def _(spark, d):
    folder = stream.run_available(stream.responses(_stream(spark, d), late="400 days"), "response", "append", stream.append_epoch)
    return spark.read.parquet(f"{folder}/rows/epoch=*").select("event_id", "click_id")
