"""Tasks and their result tables, run over the tables of a workspace.

A task is a set of result tables. Each names the marts that it is made of, and a mart the columns of tables that it needs. Where
a column is absent, the result is left out and said so in the task's status table; nothing fails. Marts are stored at their first use, so that a
run of all tasks joins order lines and orders once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyforge.plans.catalogue import FOUND as ALL
from tallyforge.sources import bindings as B
from tallyforge.sources.workspace import Workspace

#: Tables that columns are looked up in: by name, raw or derived.
TABLES: dict[str, Callable[[Workspace], DataFrame]] = {
    "order_lines": lambda w: B.order_lines(w.spark, w),
    "products": lambda w: B.products(w.spark, w),
    **{t: (lambda w, t=t: w.table(t)) for t in ("lineitem", "orders", "part", "events", "supplier", "nation", "conversations")},
}
_LINES = "shop_id order_id sku_id day quantity paid_amount"
_AD = {"lineitem": "l_suppkey l_shipdate l_extendedprice l_discount l_tax l_quantity l_returnflag", "supplier": "s_suppkey s_nationkey", "nation": "n_nationkey n_regionkey"}
_EVENTS = {"events": "event_id ts user_id event_type value props"}
_PRODUCTS = {"products": "sku_id sku_name category_l1 category_l2 price"}
#: What each mart needs: columns by table.
MARTS: dict[str, dict[str, str]] = {
    "lines": {"order_lines": _LINES},
    "refunds": {"order_lines": f"{_LINES} refunded"},
    "reasons": {"order_lines": f"{_LINES} refunded reason"},
    "carriers": {"order_lines": f"{_LINES} refunded carrier buyer_id"},
    "channels": {"order_lines": f"{_LINES} carrier priority buyer_id"},
    "buyers": {"order_lines": f"{_LINES} buyer_id"},
    "anchors": {"order_lines": f"{_LINES} line priority refunded"},
    "shop_days": {"order_lines": f"{_LINES} buyer_id refunded"},
    "sku_perf": {"order_lines": f"{_LINES} refunded", **_PRODUCTS},
    "stock": {"order_lines": f"{_LINES} refunded", "products": "sku_id size"},
    "links": {"order_lines": f"{_LINES} priority", "products": "sku_id sku_name", **_EVENTS},
    "refund_time": {"lineitem": "l_suppkey l_orderkey l_shipdate l_extendedprice l_discount l_returnflag"},
    "ads": _AD,
    "sales_by_supplier": {"order_lines": f"{_LINES} supplier_id spend"},
    "traffic": _EVENTS,
    "funnel": _EVENTS,
    "note_refunds": _EVENTS,
    "features": _EVENTS,
    "comments": {"conversations": "conv_id turn role text"},
    "conversations": {"conversations": "conv_id turn role text"},
    "counts": {t: "" for t in ("orders", "lineitem", "part", "events", "conversations")},
}
#: Marts that a workspace may be given (see bindings.from_contracts), and the columns that they then need.
GIVEN: dict[str, dict[str, str]] = {
    "shop_days": {"daily": "shop_id day gmv paid_orders paid_buyers units refund_amount"},
    "funnel": {"note_funnel": "k views clicks carts orders gmv"},
    "note_refunds": {"note_funnel": "k views clicks carts orders refunds gmv"},
    "features": {"features": "k style angle"},
    "anchors": {"anchors": "shop_id note_id sku_id publish_day", "order_lines": f"{_LINES} refunded"},
    "comments": {"comments": "conv_id turn text"},
}


@dataclass(frozen=True)
class Result:
    """One result table: the registered query that makes it and its marts."""

    query: str
    marts: tuple[str, ...]

    def missing(self, workspace: Workspace) -> list[str]:
        """Columns (table.column) that it needs and the workspace lacks."""
        out = []
        for mart in self.marts:
            given = GIVEN.get(mart, {})
            needs = given if given and workspace.given.issuperset(given) else MARTS[mart]
            for name, columns in needs.items():
                try:
                    have = set((workspace.marts[name] if name in workspace.given else TABLES[name](workspace)).columns)
                except KeyError as e:
                    out.append(f"{e.args[0]}.*")
                    continue
                out += [f"{name}.{c}" for c in columns.split() if c not in have]
        return sorted(set(out))


def _task(**results: str) -> dict[str, Result]:
    """name="query: marts"; a bare query's name is its result's."""
    return {name: Result(q, tuple(marts.split())) for name, spec in results.items() for q, _, marts in [spec.partition(":")]}


TASKS: dict[str, dict[str, Result]] = {
    "data_quality_check": _task(row_counts="table_counts: counts", sources="source_summary: counts"),
    "ad_data_quality_check": _task(quality="ad_capabilities: ads"),
    "paid_traffic_efficiency": _task(
        efficiency="paid_efficiency: ads", hierarchy="paid_hierarchy: ads", reported="paid_reported: ads", roas="roas_sources: sales_by_supplier",
        elasticity="spend_response: ads", budget="budget_action: ads",
    ),
    "account_baseline": _task(days="account_baseline: traffic", windows="posting_windows: traffic", slots="publish_windows: traffic"),
    "note_funnel": _task(totals="funnel_totals: note_refunds", notes="note_funnel_rates: funnel", bars="threshold_bars: funnel"),
    "sku_counterfactual_lift": _task(windows="anchored_lift: anchors", summary="lift_summary: anchors"),
    "content_response_curve": _task(anchors="response_windows: anchors", curve="response_totals: anchors"),
    "cover_style_effect": _task(effects="group_effects: funnel features"),
    "copy_angle_effect": _task(effects="angle_effects: funnel features"),
    "product_content_interaction": _task(interaction="feature_interaction: funnel features", linked="linked_interaction: links", notes="linked_note_rows: links"),
    "product_opportunity_matrix": _task(skus="product_opportunity: stock", types="opportunity_types: stock"),
    "comment_demand_mining": _task(
        themes="themes: comments", trend="theme_trend: comments", groups="demand_groups: comments", polarity="group_polarity: comments",
        hooks="objection_hooks: comments", seeds="seed_themes: comments", series="theme_series: comments", directions="theme_directions: comments", context="comment_context: conversations",
    ),
    "content_portfolio_optimization": _task(categories="portfolio_mix: sku_perf", styles="style_mix: features"),
    "weekly_experiment_matrix": _task(plan="experiment_plan: sku_perf"),
    "reshoot_repost_candidates": _task(candidates="reshoot_candidates: note_refunds", shrunk="reshoot_rank: funnel"),
    "hypothesis_knowledge_base": _task(hypotheses="hypotheses: sku_perf"),
    "weekly_business_review": _task(sections="weekly_review: shop_days traffic comments"),
    "refund_structure_diagnosis": _task(
        layers="refund_axes: carriers", reasons="refund_reasons: reasons", carriers="refund_carrier: carriers", products="product_refund: sku_perf",
        trend="refund_trend: carriers", notes="note_refund_outliers: note_refunds",
    ),
    "core_business_diagnosis": _task(
        snapshot="core_snapshot: shop_days", net_revenue="net_revenue_days: shop_days", refund_time="refund_time_days: refund_time", depth="traffic_depth: traffic",
        months="monthly_overview: shop_days", trend="mom_change: shop_days", weeks="wow_calendar: shop_days", projection="trend_of_totals: shop_days",
        seasonality="dow_seasonality: shop_days", changepoints="changepoints: shop_days", anomalies="anomaly_days: shop_days", benchmark="latest_benchmark: shop_days",
        bridge="gmv_bridge: buyers", shares="bridge_shares: buyers", ledger="ledger: shop_days buyers", carriers="carrier_structure: carriers",
        funnel="store_funnel: funnel", events="event_lift: shop_days",
    ),
    "demand_funnel_diagnosis": _task(
        cart_to_pay="demand_funnel: traffic", intent="sku_intent: funnel", wishlist="wishlist_days: traffic", wishlist_trend="wishlist_trend: traffic", people="person_days: traffic",
    ),
    "search_efficiency_diagnosis": _task(
        funnel="search_funnel: funnel", coverage="search_coverage: funnel", trend="search_trend: traffic", weighted="weighted_rate: traffic",
        terms="search_term_class: funnel", leaks="search_leaks: funnel", order="terms_class_first: funnel",
    ),
    "audience_structure_diagnosis": _task(
        conversion="audience_conversion: traffic", cycles="cycle_conversion: traffic", collapsed="cycle_collapse: shop_days", sources="source_structure: channels",
        value="audience_value: buyers", composition="audience_composition: traffic", scope="audience_scope: traffic",
    ),
    "note_commercial_diagnosis": _task(
        pareto="note_pareto: funnel", conversion="note_conversion_outliers: funnel", refunds="note_refund_outliers: note_refunds", referral="referral: traffic",
        referral_totals="referral_totals: traffic",
    ),
    "sku_structure_diagnosis": _task(
        pareto="sku_pareto: sku_perf", curve="cumulative_curve: sku_perf", concentration="concentration: sku_perf", net_value="sku_net_rows: sku_perf",
        products="sku_net_value: sku_perf", refunds="sku_refund_outliers: sku_perf", bands="price_bands: sku_perf", sweet_spot="price_sweet_spot: sku_perf",
        order_value="aov_tags: sku_perf", categories="category_l2: sku_perf",
    ),
    "channel_structure_diagnosis": _task(
        scale="channel_scale: carriers", conversion="channel_conversion: carriers", days="carrier_days: carriers", matrix="channel_matrix: channels", refunds="refund_carrier: carriers",
    ),
    "refund_root_cause_diagnosis": _task(stages="refund_stages: carriers", categories="category_refund: sku_perf", bands="refund_price_bands: sku_perf"),
}
STATUS = "task_id string, result string, query string, judgable boolean, reason string"


def run_task(task_id: str, workspace: Workspace) -> dict[str, DataFrame]:
    """The task's result tables by name, and ``status``: a row for each, those left out too, with the columns that they lack."""
    if task_id not in TASKS:
        raise KeyError(f"unknown task: {task_id}")
    out, rows = {}, []
    for name, result in TASKS[task_id].items():
        lacks = result.missing(workspace)
        if not lacks:
            out[name] = ALL[result.query].run(workspace.spark, workspace)
        rows.append((task_id, name, result.query, not lacks, "missing: " + ", ".join(lacks) if lacks else None))
    return out | {"status": workspace.spark.createDataFrame(rows, STATUS)}


def run_tasks(workspace: Workspace, tasks: tuple[str, ...] = tuple(TASKS)) -> dict[str, dict[str, DataFrame]]:
    return {t: run_task(t, workspace) for t in tasks}


def coverage(workspace: Workspace, tasks: tuple[str, ...] = tuple(TASKS)) -> DataFrame:
    """(task_id, results, judgable, producible, reasons): a result is judgable if its columns are there and it has a row."""
    rows = []
    for task in tasks:
        found = run_task(task, workspace)
        reasons = {r.result: r.reason for r in found.pop("status").collect() if r.reason}
        reasons |= {name: "no rows" for name, df in found.items() if df.isEmpty()}
        judgable = len(TASKS[task]) - len(reasons)
        said = "; ".join(f"{k}: {v}" for k, v in sorted(reasons.items()))
        rows.append((task, len(TASKS[task]), judgable, judgable > 0, said or None))
    return workspace.spark.createDataFrame(rows, "task_id string, results long, judgable long, producible boolean, reasons string")
