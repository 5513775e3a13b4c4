"""The registered queries on operators of this library, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.operators import compare, distribution, ranks, series, windows
from tallyforge.plans import marts
from tallyforge.plans import sqltext as T
from tallyforge.sources import bindings as B
from tallyforge.sources.workspace import Source, mart

FOUND: dict[str, "Query"] = {}
DIGITS = 4


@dataclass
class Query:
    run: Callable[[SparkSession, Source], DataFrame]
    sql: str | None


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, as sums of floats depend on their order."""
    return df.select(*(F.round(c, digits).alias(c) + F.lit(0.0) if t == "double" else F.col(c) for c, t in df.dtypes)).toDF(*df.columns)


def query(name: str, sql: str | None = None, doubles: str = "", head: str = "", digits: int = DIGITS) -> Callable:
    """Registers a function of (spark, source: a folder or a workspace); head: common table expressions before sql."""

    def register(f: Callable[[SparkSession, Source], DataFrame]) -> Callable:
        text = sql if sql is None else (T.rounded(f"{head}\n--\n{sql}" if head else sql, doubles, digits) if doubles else head + sql)
        FOUND[name] = Query(lambda spark, sf_dir: finish(f(spark, sf_dir), digits), text)
        return f

    return register


def lines(spark: SparkSession, source: Source) -> DataFrame:
    return B.order_lines(spark, source)


@mart
def daily(spark: SparkSession, source: Source) -> DataFrame:
    return marts.shop_daily(lines(spark, source))


@mart
def sku_days(spark: SparkSession, source: Source) -> DataFrame:
    return marts.daily_sku_sales(lines(spark, source), B.line_count(spark, source))


@mart
def perf(spark: SparkSession, source: Source) -> DataFrame:
    return marts.sku_performance(lines(spark, source), B.products(spark, source))


def monthly(spark: SparkSession, source: Source) -> DataFrame:
    return marts.shop_monthly(daily(spark, source))


# Marts


@query("daily_sku_sales", "SELECT shop_id, day, sku_id, units, gmv, order_count FROM daily", "units gmv", T.with_(T.ORDER_LINES, T.DAILY_SKU))
def _(spark, d):
    return sku_days(spark, d)


@query(
    "monthly_overview",
    """SELECT shop_id, strftime(day, '%Y-%m') AS period_month, sum(gmv) AS gmv, CAST(sum(paid_orders) AS BIGINT) AS paid_orders, CAST(sum(paid_buyers) AS BIGINT) AS paid_buyer_days, avg(paid_buyers) AS avg_daily_paid_buyers,
    sum(units) AS paid_units, sum(refund_amount) AS refund_amount_pay, sum(gmv) - sum(refund_amount) AS net_gmv_pay, avg(gmv / paid_orders) AS avg_daily_aov, sum(refund_amount) / sum(gmv) AS refund_rate_pay FROM sd GROUP BY ALL""",
    "gmv avg_daily_paid_buyers paid_units refund_amount_pay net_gmv_pay avg_daily_aov refund_rate_pay", T.with_(T.ORDER_LINES, T.SHOP_DAY),
)
def _(spark, d):
    return marts.monthly_overview(daily(spark, d))


@query(
    "note_funnel_rates",
    """SELECT k, views, clicks, carts, orders, refunds, gmv, CASE WHEN views > 0 THEN clicks / views END AS click_rate, CASE WHEN clicks > 0 THEN carts / clicks END AS cart_rate, CASE WHEN carts > 0 THEN orders / carts END AS pay_rate,
    CASE WHEN clicks > 0 THEN gmv / clicks END AS gmv_per_click, CASE WHEN views > 0 THEN gmv / views * 1000 END AS gmv_per_1k FROM nf""",
    "gmv click_rate cart_rate pay_rate gmv_per_click gmv_per_1k", T.with_(T.EVENTS, T.FUNNEL),
)
def _(spark, d):
    n = lambda c: F.col(c)
    return B.note_funnel(spark, d).withColumns({"click_rate": C.ratio(n("clicks"), n("views")), "cart_rate": C.ratio(n("carts"), n("clicks")), "pay_rate": C.ratio(n("orders"), n("carts")), "gmv_per_click": C.ratio(n("gmv"), n("clicks")), "gmv_per_1k": C.ratio(n("gmv"), n("views")) * 1000})


# Anchored windows


@query(
    "anchored_lift",
    """SELECT a.shop_id, note_id, a.sku_id, publish_day, w AS "window", coalesce(sum(units) FILTER (day >= publish_day + p0 AND day < publish_day + p1), 0.0) AS pre_units,
    coalesce(sum(units) FILTER (day >= publish_day + q0 AND day < publish_day + q1), 0.0) AS post_units,
    count(*) FILTER ((day >= publish_day + p0 AND day < publish_day + p1) OR (day >= publish_day + q0 AND day < publish_day + q1)) AS matched_sales_days,
    CASE WHEN matched_sales_days > 0 THEN post_units - pre_units END AS absolute_lift, CASE WHEN pre_units > 0 THEN (post_units - pre_units) / pre_units END AS relative_lift
    FROM anchors a CROSS JOIN specs LEFT JOIN daily USING (shop_id, sku_id) GROUP BY a.shop_id, note_id, a.sku_id, publish_day, w, p0, p1, q0, q1""",
    "pre_units post_units absolute_lift relative_lift",
    T.with_(T.ORDER_LINES, T.DAILY_SKU, "anchors AS (SELECT shop_id, order_id || '-' || line AS note_id, sku_id, day AS publish_day FROM ol WHERE priority = '1-URGENT')",
            "specs(w, p0, p1, q0, q1) AS (VALUES ('d0_1', -1, 0, 0, 1), ('d1_3', -3, 0, 1, 4), ('d4_7', -4, 0, 4, 8), ('d8_14', -7, 0, 8, 15))"),
)
def anchored_lift(spark, d):
    return windows.anchored_lift(B.anchors(spark, d), sku_days(spark, d))


@query(
    "response_windows",
    """SELECT a.shop_id, note_id, a.sku_id, publish_day, coalesce(sum(units) FILTER (g >= 0 AND g < 1), 0.0) AS d0_1_units, coalesce(sum(units) FILTER (g >= 1 AND g < 4), 0.0) AS d1_3_units,
    coalesce(sum(units) FILTER (g >= 4 AND g < 8), 0.0) AS d4_7_units, coalesce(sum(units) FILTER (g >= 8 AND g < 15), 0.0) AS d8_14_units, count(*) FILTER (g >= 0 AND g < 15) AS matched_sales_days
    FROM (SELECT a.*, units, day - publish_day AS g FROM anchors a LEFT JOIN daily USING (shop_id, sku_id)) a GROUP BY a.shop_id, note_id, a.sku_id, publish_day""",
    "d0_1_units d1_3_units d4_7_units d8_14_units",
    T.with_(T.ORDER_LINES, T.DAILY_SKU, "anchors AS (SELECT shop_id, order_id || '-' || line AS note_id, sku_id, day AS publish_day FROM ol WHERE priority = '1-URGENT')"),
)
def _(spark, d):
    return windows.response_windows(B.anchors(spark, d), sku_days(spark, d))


@query(
    "event_lift",
    """SELECT *, (event_value - baseline_value) / baseline_value AS lift_pct FROM (
    SELECT shop_id, 'gmv' AS metric, avg(gmv) FILTER (e) AS event_value, avg(gmv) FILTER (NOT e) AS baseline_value FROM m GROUP BY ALL UNION ALL
    SELECT shop_id, 'paid_orders', avg(paid_orders) FILTER (e), avg(paid_orders) FILTER (NOT e) FROM m GROUP BY ALL)""",
    "event_value baseline_value lift_pct", T.with_(T.ORDER_LINES, T.SHOP_DAY, "m AS (SELECT *, day(day) IN (1, 15) AS e FROM sd)"),
)
def _(spark, d):
    rows = daily(spark, d)
    return windows.event_lift(rows, rows.where(F.dayofmonth("day").isin(1, 15)).select("day"), ["shop_id"], ["gmv", "paid_orders"])


# Series

MOM = f"lag(gmv) OVER w AS b, gmv - b AS delta, CASE WHEN b <> 0 THEN (gmv - b) / b END AS pct, {T.direction('coalesce(gmv - b, 0)')} AS direction"


@query("mom_change", f"SELECT * EXCLUDE (b) FROM (SELECT *, {MOM} FROM sm WINDOW w AS (PARTITION BY shop_id ORDER BY period_month))", "gmv delta pct", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH))
def _(spark, d):
    return series.mom_change(monthly(spark, d), ["shop_id"], "period_month", "gmv")


WOW = f"lag(total) OVER w AS b, total - b AS delta, CASE WHEN b <> 0 THEN (total - b) / b END AS pct, {T.direction('coalesce(total - b, 0)')} AS direction"


@query(
    "wow_rows",
    f"""SELECT * EXCLUDE (b) FROM (SELECT *, {WOW} FROM (SELECT shop_id, week, min(day) AS week_start, max(day) AS week_end, sum(gmv) AS total FROM (SELECT *, (row_number() OVER (PARTITION BY shop_id ORDER BY day) - 1) // 7 AS week FROM sd) GROUP BY ALL HAVING count(*) = 7)
    WINDOW w AS (PARTITION BY shop_id ORDER BY week))""",
    "total delta pct", T.with_(T.ORDER_LINES, T.SHOP_DAY),
)
def _(spark, d):
    return series.weeks_by_rows(daily(spark, d).select("shop_id", "day", "gmv"), ["shop_id"], "day", "gmv")


WEEKS = "wk AS (SELECT shop_id, CAST(isoyear(day) AS BIGINT) AS iso_year, CAST(week(day) AS BIGINT) AS iso_week, min(day) AS week_start, max(day) AS week_end, count(*) AS days_in_bucket, sum(gmv) AS total FROM sd GROUP BY ALL)"


@query("wow_calendar", f"SELECT * EXCLUDE (b) FROM (SELECT *, {WOW} FROM wk WINDOW w AS (PARTITION BY shop_id ORDER BY iso_year, iso_week))", "total delta pct", T.with_(T.ORDER_LINES, T.SHOP_DAY, WEEKS))
def _(spark, d):
    return series.weeks_by_calendar(daily(spark, d).select("shop_id", "day", "gmv"), ["shop_id"], "day", "gmv")


@query("moving_avg", "SELECT shop_id, day, gmv, avg(gmv) OVER (PARTITION BY shop_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS moving_avg FROM sd", "gmv moving_avg", T.with_(T.ORDER_LINES, T.SHOP_DAY))
def _(spark, d):
    return series.moving_average(daily(spark, d).select("shop_id", "day", "gmv"), ["shop_id"], "day", "gmv", 3)


TREND = """ix AS (SELECT shop_id, period_month, gmv, CAST(row_number() OVER (PARTITION BY shop_id ORDER BY period_month) - 1 AS DOUBLE) AS i FROM sm),
 st AS (SELECT shop_id, count(*) AS n, avg(gmv) AS m, regr_slope(gmv, i) AS slope, regr_sxx(gmv, i) AS sxx, regr_syy(gmv, i) AS syy, regr_sxy(gmv, i) AS sxy, arg_min(gmv, i) AS first_value, arg_max(gmv, i) AS last_value, min(period_month) AS start_period, max(period_month) AS end_period FROM ix GROUP BY shop_id),
 tr AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS slope_se FROM st)"""
TREND_SELECT = f"""SELECT shop_id, n, {T.direction('slope')} AS direction, slope, first_value, last_value, m + slope * (n - 1) / 2 AS fitted_last, start_period, end_period, slope_se, slope / slope_se AS t_stat, abs(slope / slope_se) >= 2 AS significant, slope * (n - 1) / m AS rel_slope FROM tr"""
TREND_DOUBLES = "slope first_value last_value fitted_last slope_se t_stat rel_slope"


@query("trend_summary", TREND_SELECT, TREND_DOUBLES, T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH, TREND))
def _(spark, d):
    return series.trend_summary(monthly(spark, d), ["shop_id"], "period_month", "gmv")


@query("trend_projection", f"SELECT *, 7::BIGINT AS horizon, greatest(fitted_last + slope * 7, 0.0) AS projected_value FROM ({TREND_SELECT}) WHERE n >= 4 AND significant", TREND_DOUBLES + " projected_value", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH, TREND))
def _(spark, d):
    return series.trend_projection(series.trend_summary(monthly(spark, d), ["shop_id"], "period_month", "gmv"), 7, True)


RESID = """ri AS (SELECT shop_id, day, gmv, CAST(row_number() OVER (PARTITION BY shop_id ORDER BY day) - 1 AS DOUBLE) AS i FROM sd),
 rf AS (SELECT shop_id, regr_slope(gmv, i) AS b, regr_intercept(gmv, i) AS a FROM ri GROUP BY shop_id), rs AS (SELECT ri.*, gmv - (a + b * i) AS residual FROM ri JOIN rf USING (shop_id))"""


@query(
    "dow_seasonality",
    "SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY mean_level DESC, weekday) = 1 AS is_peak, row_number() OVER (PARTITION BY shop_id ORDER BY mean_level, weekday) = 1 AS is_trough FROM (SELECT shop_id, CAST(isodow(day) - 1 AS BIGINT) AS weekday, avg(residual) AS mean_level, true AS detrended FROM rs GROUP BY ALL)",
    "mean_level", T.with_(T.ORDER_LINES, T.SHOP_DAY, RESID), digits=3,
)
def _(spark, d):
    return series.weekday_seasonality(daily(spark, d).select("shop_id", "day", "gmv"), ["shop_id"], "day", "gmv")


@query(
    "anomaly_days",
    "SELECT shop_id, day, gmv, residual, z, CASE WHEN z > 0 THEN 'above' ELSE 'below' END AS direction FROM (SELECT *, (residual - avg(residual) OVER w) / stddev_pop(residual) OVER w AS z FROM rs WINDOW w AS (PARTITION BY shop_id)) WHERE abs(z) >= 2",
    "gmv residual z", T.with_(T.ORDER_LINES, T.SHOP_DAY, RESID), digits=3,
)
def _(spark, d):
    return series.anomaly_days(daily(spark, d).select("shop_id", "day", "gmv"), ["shop_id"], "day", "gmv")


def _split_sql(source: str, keys: str) -> str:
    return f"""SELECT * EXCLUDE (r) FROM (SELECT {keys}, CAST(i AS BIGINT) AS "index", before_mean, after_mean, after_mean - before_mean AS shift, row_number() OVER (PARTITION BY {keys} ORDER BY abs(after_mean - before_mean) DESC, i) AS r FROM (
    SELECT {keys}, i, bs / k AS before_mean, (t - bs) / (n - k) AS after_mean FROM (SELECT {keys}, i, i - min(i) OVER p AS k, count(*) OVER p AS n, sum(gmv) OVER p AS t, sum(gmv) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bs FROM {source} WINDOW p AS (PARTITION BY {keys})) WHERE k >= 3 AND n - k >= 3)) WHERE r = 1"""


@query("changepoint", _split_sql("ix", "shop_id"), "before_mean after_mean shift", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH, TREND), digits=3)
def _(spark, d):
    return series.changepoint(monthly(spark, d), ["shop_id"], "period_month", "gmv")


CP = f"""c0 AS (SELECT shop_id, gmv, i, '' AS path, abs(avg(gmv) OVER (PARTITION BY shop_id)) AS scale FROM ix),
 s0 AS (SELECT x.*, abs(shift) / scale AS rel_shift FROM ({_split_sql('c0', 'shop_id, path')}) x JOIN (SELECT DISTINCT shop_id, scale FROM c0) USING (shop_id) WHERE abs(shift) / scale >= 0.15),
 c1 AS (SELECT shop_id, gmv, i, path || CASE WHEN i < "index" THEN 'L' ELSE 'R' END AS path, scale FROM c0 JOIN (SELECT shop_id, path, "index" FROM s0) USING (shop_id, path)),
 s1 AS (SELECT x.*, abs(shift) / scale AS rel_shift FROM ({_split_sql('c1', 'shop_id, path')}) x JOIN (SELECT DISTINCT shop_id, scale FROM c0) USING (shop_id) WHERE abs(shift) / scale >= 0.15),
 c2 AS (SELECT shop_id, gmv, i, path || CASE WHEN i < "index" THEN 'L' ELSE 'R' END AS path, scale FROM c1 JOIN (SELECT shop_id, path, "index" FROM s1) USING (shop_id, path)),
 s2 AS (SELECT x.*, abs(shift) / scale AS rel_shift FROM ({_split_sql('c2', 'shop_id, path')}) x JOIN (SELECT DISTINCT shop_id, scale FROM c0) USING (shop_id) WHERE abs(shift) / scale >= 0.15)"""


@query("changepoints", """SELECT * EXCLUDE (path, r) FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY path) AS r FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2)) WHERE r <= 3""", "before_mean after_mean shift rel_shift", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH, TREND, CP), digits=3)
def _(spark, d):
    return series.changepoints(monthly(spark, d), ["shop_id"], "period_month", "gmv")


@query("self_percentile", "SELECT shop_id, period_month, gmv, (rank() OVER (PARTITION BY shop_id ORDER BY gmv) - 1 + 0.5 * count(*) OVER (PARTITION BY shop_id, gmv)) / count(*) OVER (PARTITION BY shop_id) AS self_percentile FROM sm", "gmv self_percentile", T.with_(T.ORDER_LINES, T.SHOP_DAY, T.SHOP_MONTH))
def _(spark, d):
    return series.self_percentile(monthly(spark, d), ["shop_id"], "gmv")


@query(
    "latest_benchmark",
    """SELECT shop_id, iso_year, iso_week, total, self_percentile, periods FROM (SELECT *, (rank() OVER (PARTITION BY shop_id ORDER BY total) - 1 + 0.5 * count(*) OVER (PARTITION BY shop_id, total)) / count(*) OVER (PARTITION BY shop_id) AS self_percentile, count(*) OVER (PARTITION BY shop_id) AS periods,
    row_number() OVER (PARTITION BY shop_id ORDER BY iso_year DESC, iso_week DESC) AS r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY iso_year DESC, iso_week DESC) AS q FROM wk) WHERE NOT (q = 1 AND days_in_bucket < 7))) WHERE r = 1 AND periods >= 4""",
    "total self_percentile", T.with_(T.ORDER_LINES, T.SHOP_DAY, WEEKS),
)
def _(spark, d):
    return series.latest_benchmark(daily(spark, d).select("shop_id", "day", "gmv"), ["shop_id"], "day", "gmv")


# Distribution and concentration


@query("describe", "SELECT category_l1, count(gmv) AS n, avg(gmv) AS mean, quantile_cont(gmv, 0.5) AS median, quantile_cont(gmv, 0.25) AS p25, quantile_cont(gmv, 0.75) AS p75, quantile_cont(gmv, 0.75) - quantile_cont(gmv, 0.25) AS iqr, min(gmv) AS \"min\", max(gmv) AS \"max\", stddev_pop(gmv) / avg(gmv) AS cv FROM spp GROUP BY ALL", "mean median p25 p75 iqr \"min\" \"max\" cv", T.with_(T.ORDER_LINES, T.SKU_PERF), digits=2)
def _(spark, d):
    return distribution.describe(perf(spark, d), ["category_l1"], "gmv")


BANDS = """qe AS (SELECT [quantile_cont(price, 0.0), quantile_cont(price, 0.25), quantile_cont(price, 0.5), quantile_cont(price, 0.75)] AS e FROM spp),
 bd AS (SELECT spp.*, greatest(len(list_filter(e, lambda x: price >= x)) - 1, 0) AS band, e[band + 1] AS low, e[band + 2] AS high FROM spp, qe)"""


@query("price_bands", "SELECT CAST(band AS BIGINT) AS band, low, high, count(*) AS sku_count, count(*) / sum(count(*)) OVER () AS sku_share, sum(gmv) AS gmv, sum(gmv) / sum(sum(gmv)) OVER () AS gmv_share FROM bd GROUP BY band, low, high", "low high sku_share gmv gmv_share", T.with_(T.ORDER_LINES, T.SKU_PERF, BANDS))
def _(spark, d):
    bands = distribution.banded(perf(spark, d), [], "price").groupBy("band", "low", "high").agg(F.count("*").alias("sku_count"), F.sum("gmv").alias("gmv"))
    whole = bands.agg(F.sum("sku_count").alias("_c"), F.sum("gmv").alias("_g"))
    return bands.crossJoin(F.broadcast(whole)).select("band", "low", "high", "sku_count", (F.col("sku_count") / F.col("_c")).alias("sku_share"), "gmv", (F.col("gmv") / F.col("_g")).alias("gmv_share"))  # one row of totals


@query(
    "price_sweet_spot",
    "SELECT *, row_number() OVER (ORDER BY net_margin DESC, band) = 1 AS is_sweet_spot FROM (SELECT CAST(band AS BIGINT) AS band, low, high, count(*) AS sku_count, sum(refund_orders) / sum(paid_orders) AS refund_rate_pay, sum(net_gmv) / sum(gmv) AS net_margin FROM bd GROUP BY band, low, high)",
    "low high refund_rate_pay net_margin", T.with_(T.ORDER_LINES, T.SKU_PERF, BANDS),
)
def _(spark, d):
    bands = distribution.banded(perf(spark, d), [], "price").groupBy("band", "low", "high").agg(F.count("*").alias("sku_count"), (F.sum("refund_orders") / F.sum("paid_orders")).alias("refund_rate_pay"), (F.sum("net_gmv") / F.sum("gmv")).alias("net_margin"))
    best = bands.agg(F.max_by("band", F.struct("net_margin", -F.col("band"))).alias("_b"))
    return bands.crossJoin(F.broadcast(best)).withColumn("is_sweet_spot", F.col("band") == F.col("_b")).drop("_b")  # one row


@query("histogram", 'SELECT CAST(b.bin AS BIGINT) AS bin, low, high, count(p.bin) AS "count", count(p.bin) / sum(count(p.bin)) OVER () AS share FROM (VALUES (0, 0.0::DOUBLE, 1000.0::DOUBLE), (1, 1000, 1250), (2, 1250, 1500), (3, 1500, 1750), (4, 1750, 5000), (5, 5000, NULL)) b(bin, low, high) LEFT JOIN (SELECT CASE WHEN p_retailprice >= 5000 THEN 5 WHEN p_retailprice >= 1750 THEN 4 WHEN p_retailprice >= 1500 THEN 3 WHEN p_retailprice >= 1250 THEN 2 WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END AS bin FROM part) p ON b.bin = p.bin GROUP BY ALL', "low high share")
def _(spark, d):
    return distribution.histogram(B.products(spark, d), "price", [0, 1000, 1250, 1500, 1750, 5000])


@query("bimodality", "SELECT category_l1, count(*) AS n, (skewness(price) ^ 2 + 1) / (kurtosis(price) + 3.0 * (count(*) - 1) ^ 2 / ((count(*) - 2) * (count(*) - 3))) AS bimodality FROM spp GROUP BY ALL HAVING count(*) >= 4", "bimodality", T.with_(T.ORDER_LINES, T.SKU_PERF))
def _(spark, d):
    return distribution.bimodality(perf(spark, d), ["category_l1"], "price")


def _concentration_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, sum(v) AS total, (2 * sum(u * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)) AS gini, sum(v * v) / (sum(v) * sum(v)) AS hhi, sum(v) FILTER (w <= k) / sum(v) AS top_share FROM (
    SELECT {keys}, gmv AS v, row_number() OVER (PARTITION BY {keys} ORDER BY gmv) AS u, row_number() OVER (PARTITION BY {keys} ORDER BY gmv DESC) AS w, greatest(1, round_even(count(*) OVER (PARTITION BY {keys}) * 0.2, 0)) AS k FROM {source}) GROUP BY ALL"""


@query("concentration", _concentration_sql("category_l1", "spp"), "total gini hhi top_share", T.with_(T.ORDER_LINES, T.SKU_PERF))
def _(spark, d):
    return distribution.concentration(perf(spark, d), ["category_l1"], "gmv")


@query("concentration_trend", _concentration_sql("year", "sy"), "total gini hhi top_share", T.with_(T.ORDER_LINES, "sy AS (SELECT CAST(year(day) AS BIGINT) AS year, sku_id, sum(paid_amount) AS gmv FROM ol GROUP BY ALL)"))
def _(spark, d):
    return distribution.concentration(lines(spark, d).groupBy(F.year("day").cast("long").alias("year"), "sku_id").agg(F.sum("paid_amount").alias("gmv")), ["year"], "gmv")


CURVE = """cv AS (SELECT category_l2, sku_id, gmv, row_number() OVER w AS rank, row_number() OVER w / count(*) OVER (PARTITION BY category_l2) AS cum_item_frac, gmv / sum(gmv) OVER (PARTITION BY category_l2) AS share,
 sum(gmv) OVER (PARTITION BY category_l2 ORDER BY gmv DESC, sku_id ROWS UNBOUNDED PRECEDING) / sum(gmv) OVER (PARTITION BY category_l2) AS cum_share FROM spp WINDOW w AS (PARTITION BY category_l2 ORDER BY gmv DESC, sku_id))"""


@query("cumulative_curve", "SELECT * FROM cv", "gmv cum_item_frac share cum_share", T.with_(T.ORDER_LINES, T.SKU_PERF, CURVE))
def _(spark, d):
    return distribution.pareto(perf(spark, d), ["category_l2"], "sku_id", "gmv")


@query("sku_pareto", "SELECT category_l2, max(rank) AS items, min(rank) FILTER (cum_share >= 0.8 - 1e-12) AS items_for_80, max(cum_share) FILTER (rank <= greatest(1, ceil(n * 0.1))) AS top_decile_share FROM (SELECT *, count(*) OVER (PARTITION BY category_l2) AS n FROM cv) GROUP BY ALL", "top_decile_share", T.with_(T.ORDER_LINES, T.SKU_PERF, CURVE))
def _(spark, d):
    return distribution.pareto_summary(distribution.pareto(perf(spark, d), ["category_l2"], "sku_id", "gmv"), ["category_l2"])


@query("global_rank", "SELECT sku_id, gmv, row_number() OVER w AS rank, sum(gmv) OVER (ORDER BY gmv DESC, sku_id ROWS UNBOUNDED PRECEDING) / sum(gmv) OVER () AS cum_share FROM (SELECT sku_id, round(gmv, 4) AS gmv FROM spp) WINDOW w AS (ORDER BY gmv DESC, sku_id)", "gmv cum_share", T.with_(T.ORDER_LINES, T.SKU_PERF))
def _(spark, d):
    """Amounts are ranked as shown, to four decimals: what is beyond depends on the order in which a SKU's lines were added, and would decide between equal amounts."""
    ranked = ranks.global_rank(perf(spark, d).select("sku_id", F.round("gmv", DIGITS).alias("gmv")), [F.desc("gmv"), F.asc("sku_id")], "gmv")
    return ranked.select("sku_id", "gmv", F.col("rank").cast("long").alias("rank"), (F.col("running") / F.col("total")).alias("cum_share"))


# Comparisons

TOP2 = """g AS (SELECT category_l1, carrier, count(DISTINCT order_id) AS n, count(DISTINCT CASE WHEN refunded THEN order_id END) AS k FROM ol JOIN part ON sku_id = p_partkey, LATERAL (SELECT p_type AS category_l1) GROUP BY ALL),
 t2 AS (SELECT category_l1, max(carrier) FILTER (r = 1) AS group_1, max(carrier) FILTER (r = 2) AS group_2, CAST(max(k) FILTER (r = 1) AS DOUBLE) AS k1, CAST(max(k) FILTER (r = 2) AS DOUBLE) AS k2, CAST(max(n) FILTER (r = 1) AS DOUBLE) AS n1, CAST(max(n) FILTER (r = 2) AS DOUBLE) AS n2 FROM (SELECT *, row_number() OVER (PARTITION BY category_l1 ORDER BY n DESC, carrier) AS r FROM g) WHERE r <= 2 GROUP BY ALL HAVING group_2 IS NOT NULL)"""


@query(
    "top2_compare",
    f"""SELECT category_l1, group_1, group_2, k1, n1, k2, n2, k1 / n1 - k2 / n2 AS diff, (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z, abs(z) >= 1.96 AS significant,
    NOT (({T.wilson('k1', 'n1', False)}) < ({T.wilson('k2', 'n2', True)}) OR ({T.wilson('k2', 'n2', False)}) < ({T.wilson('k1', 'n1', True)})) AS ci_overlap, (k1 / n1) / (k2 / n2) - 1 AS lift, ({T.wilson('k1', 'n1', True)}) / ({T.wilson('k2', 'n2', False)}) - 1 AS lift_ci_low,
    ({T.wilson('k1', 'n1', False)}) / ({T.wilson('k2', 'n2', True)}) - 1 AS lift_ci_high, 2.8 * sqrt(k2 / n2 * (1 - k2 / n2) * (1 / n1 + 1 / n2)) AS mde FROM t2""",
    "k1 n1 k2 n2 diff z lift lift_ci_low lift_ci_high mde", T.with_(T.ORDER_LINES, TOP2),
)
def _(spark, d):
    rows = lines(spark, d).join(B.products(spark, d).select("sku_id", "category_l1"), "sku_id").groupBy("category_l1", "carrier").agg(F.countDistinct("order_id").alias("n"), F.countDistinct(F.when(F.col("refunded"), F.col("order_id"))).alias("k"))
    return compare.top2_compare(rows, ["category_l1"], "carrier", "k", "n")


@query(
    "cmh_stratified",
    """SELECT shop_id, sum(w * (k1 / n1 - k2 / n2)) / sum(w) AS pooled_diff, (abs(sum(k1) - sum(n1 * m / t)) - 0.5) ^ 2 / sum(n1 * n2 * m * (t - m) / (t * t * (t - 1))) AS mh_chi2, mh_chi2 >= 3.841 AS significant, count(*) AS n_strata FROM (
    SELECT shop_id, day(day) AS s, CAST(count(*) FILTER (carrier = 'F') AS DOUBLE) AS n1, CAST(count(*) FILTER (carrier = 'O') AS DOUBLE) AS n2, CAST(count(*) FILTER (carrier = 'F' AND refunded) AS DOUBLE) AS k1, CAST(count(*) FILTER (carrier = 'O' AND refunded) AS DOUBLE) AS k2, k1 + k2 AS m, n1 + n2 AS t, n1 * n2 / t AS w FROM ol GROUP BY shop_id, day(day)) WHERE n1 > 0 AND n2 > 0 AND t > 1 GROUP BY shop_id""",
    "pooled_diff mh_chi2", T.with_(T.ORDER_LINES),
)
def _(spark, d):
    side = lambda c, back: F.count_if((F.col("carrier") == c) & F.col("refunded") if back else F.col("carrier") == c)
    strata = lines(spark, d).groupBy("shop_id", F.dayofmonth("day").alias("s")).agg(side("F", False).alias("n1"), side("O", False).alias("n2"), side("F", True).alias("k1"), side("O", True).alias("k2"))
    return compare.stratified(strata, ["shop_id"])


@query(
    "welch_means",
    """SELECT shop_id, ma AS mean_a, mb AS mean_b, ma - mb AS diff, (ma - mb) / sqrt(a + b) AS t, (a + b) ^ 2 / (a * a / (na - 1) + b * b / (nb - 1)) AS df, abs((ma - mb) / sqrt(a + b)) >= 1.96 AS significant, ma - mb - 1.96 * sqrt(a + b) AS ci_low, ma - mb + 1.96 * sqrt(a + b) AS ci_high FROM (
    SELECT shop_id, avg(gmv) FILTER (isodow(day) >= 6) AS ma, avg(gmv) FILTER (isodow(day) < 6) AS mb, count(*) FILTER (isodow(day) >= 6) AS na, count(*) FILTER (isodow(day) < 6) AS nb, var_samp(gmv) FILTER (isodow(day) >= 6) / na AS a, var_samp(gmv) FILTER (isodow(day) < 6) / nb AS b FROM sd GROUP BY shop_id)""",
    "mean_a mean_b diff t df ci_low ci_high", T.with_(T.ORDER_LINES, T.SHOP_DAY), digits=3,
)
def _(spark, d):
    return compare.mean_difference(daily(spark, d), ["shop_id"], F.weekday("day") >= 5, "gmv")


def _outlier_sql(family: str, item: str, k: str, n: str, source: str) -> str:
    part = f"PARTITION BY {family}" if family else ""
    cols = f"{family}, {item}" if family else item
    return f"""SELECT {cols}, {k}, {n}, baseline, rate, wilson_low, wilson_high, p_value, rk <= coalesce(max(CASE WHEN p_value <= rk / m * 0.05 THEN rk END) OVER ({part}), 0) AS fdr_significant FROM (
    SELECT *, row_number() OVER ({part} ORDER BY p_value, {item}) AS rk, count(*) OVER ({part}) AS m FROM (SELECT {cols}, {k}, {n}, baseline, {k} / {n} AS rate, {T.wilson(k, n, True)} AS wilson_low, {T.wilson(k, n, False)} AS wilson_high, {T.binomial_p(k, n, 'baseline')} AS p_value
    FROM (SELECT *, sum({k}) OVER ({part}) / sum({n}) OVER ({part}) AS baseline FROM {source}) WHERE {n} >= 30))"""


OUT = "baseline rate wilson_low wilson_high p_value"


@query("sku_refund_outliers", _outlier_sql("category_l1", "sku_id", "refund_orders", "paid_orders", "spp"), OUT, T.with_(T.ORDER_LINES, T.SKU_PERF))
def _(spark, d):
    return compare.rate_outliers(perf(spark, d).select("category_l1", "sku_id", "refund_orders", "paid_orders"), ["category_l1"], "sku_id", "refund_orders", "paid_orders")


@query("category_refund", _outlier_sql("", "category_l1", "refund_orders", "paid_orders", "(SELECT category_l1, CAST(sum(refund_orders) AS BIGINT) AS refund_orders, CAST(sum(paid_orders) AS BIGINT) AS paid_orders FROM spp GROUP BY ALL)"), OUT, T.with_(T.ORDER_LINES, T.SKU_PERF))
def _(spark, d):
    rows = perf(spark, d).groupBy("category_l1").agg(F.sum("refund_orders").alias("refund_orders"), F.sum("paid_orders").alias("paid_orders"))
    return compare.rate_outliers(rows, [], "category_l1", "refund_orders", "paid_orders")


@query("note_refund_outliers", _outlier_sql("", "note", "refunds", "orders", "(SELECT k % 10 AS note, CAST(sum(refunds) AS BIGINT) AS refunds, CAST(sum(orders) AS BIGINT) AS orders FROM nf GROUP BY ALL)"), OUT, T.with_(T.EVENTS, T.FUNNEL))
def _(spark, d):
    rows = B.note_funnel(spark, d).groupBy((F.col("k") % 10).alias("note")).agg(F.sum("refunds").alias("refunds"), F.sum("orders").alias("orders"))
    return compare.rate_outliers(rows, [], "note", "refunds", "orders")
