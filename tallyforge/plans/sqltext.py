"""Pieces of DuckDB SQL that the catalogue's oracles share."""

from __future__ import annotations

from tallyforge.functions.statistics import ERFC

ORDER_LINES = """ol AS (SELECT l_suppkey % 5 AS shop_id, l_orderkey AS order_id, l_linenumber AS line, CAST(o_orderdate AS DATE) AS day, l_partkey AS sku_id, o_custkey AS buyer_id, l_quantity AS quantity,
 l_extendedprice * (1 - l_discount) AS paid_amount, l_returnflag = 'R' AS refunded, l_linestatus AS carrier, l_extendedprice * l_tax AS spend, o_orderpriority AS priority, l_suppkey AS supplier_id, l_returnflag AS reason
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DAILY_SKU = """daily AS (SELECT shop_id, day, sku_id, sum(quantity) AS units, sum(paid_amount) AS gmv, count(DISTINCT order_id) AS order_count FROM ol WHERE NOT refunded GROUP BY ALL)"""
SHOP_DAY = """sd AS (SELECT shop_id, day, sum(paid_amount) AS gmv, count(DISTINCT order_id) AS paid_orders, count(DISTINCT buyer_id) AS paid_buyers, sum(quantity) AS units,
 sum(CASE WHEN refunded THEN paid_amount ELSE 0 END) AS refund_amount FROM ol GROUP BY ALL)"""
SHOP_MONTH = """sm AS (SELECT shop_id, strftime(day, '%Y-%m') AS period_month, sum(gmv) AS gmv FROM sd GROUP BY ALL)"""
SKU_PERF = """sp AS (SELECT sku_id, sum(paid_amount) AS gmv, count(DISTINCT order_id) AS paid_orders, sum(quantity) AS paid_units, count(DISTINCT CASE WHEN refunded THEN order_id END) AS refund_orders,
 sum(CASE WHEN refunded THEN paid_amount ELSE 0 END) AS refund_amount, sum(CASE WHEN refunded THEN 0 ELSE paid_amount END) AS net_gmv FROM ol GROUP BY sku_id),
 spp AS (SELECT sp.*, p_name AS sku_name, p_type AS category_l1, p_brand AS category_l2, p_retailprice AS price, gmv / paid_orders AS aov FROM sp JOIN part ON sku_id = p_partkey)"""
EVENTS = """ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
FUNNEL = """nf AS (SELECT k, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'signup') AS carts, count(*) FILTER (event_type = 'purchase') AS orders,
 count(*) FILTER (event_type = 'error') AS refunds, sum(value) FILTER (event_type = 'purchase') AS gmv FROM ev GROUP BY k)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def clamp(k: str, n: str) -> str:
    return f"least(greatest(CAST({k} AS DOUBLE), 0.0), CAST({n} AS DOUBLE))"


def wilson(k: str, n: str, low: bool) -> str:
    p, z = f"({clamp(k, n)} / {n})", 1.96
    center = f"({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    margin = f"{z} / (1 + {z * z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    body = f"greatest(0.0, {center} - {margin})" if low else f"least(1.0, {center} + {margin})"
    return f"CASE WHEN {n} > 0 THEN {body} ELSE 0.0 END"


def erfc(x: str) -> str:
    t = f"(1 / (1 + ({x}) / 2))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"{t} * exp(-({x}) * ({x}) + {poly})"


def binomial_p(k: str, n: str, p0: str) -> str:
    p = f"({clamp(k, n)} / {n})"
    z = f"(({p} - {p0} - 0.5 / {n}) / sqrt({p0} * (1 - {p0}) / {n}))"
    return f"CASE WHEN {n} > 0 AND {p0} > 0 AND {p0} < 1 THEN CASE WHEN {p} > {p0} AND {z} > 0 THEN 0.5 * {erfc(z + ' / ' + repr(2**0.5))} ELSE 1.0 END ELSE 1.0 END"


def direction(d: str) -> str:
    return f"CASE WHEN {d} > 1e-9 THEN 'up' WHEN {d} < -1e-9 THEN 'down' ELSE 'flat' END"


def rounded(sql: str, doubles: str, digits: int = 4) -> str:
    """sql with the named columns rounded, as the Spark side has all its doubles."""
    names = doubles.split()
    if not names:
        return sql
    with_part, body = (sql.split("\n--\n", 1) + [""])[:2] if "\n--\n" in sql else ("", sql)
    return f"{with_part} SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in names)}) FROM ({body})"
