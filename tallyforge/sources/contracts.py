"""Table contracts: canonical columns, grain, required columns, signature and header aliases.

Aliases hold a few spellings each; more come in as override rows (see harmonise.aliases).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Contract:
    name: str
    columns: dict[str, str]  # canonical name -> Spark type
    grain: tuple[str, ...] = ()  # empty: rows are unioned as they are
    required: tuple[str, ...] = ()
    signature: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)  # header -> canonical name


def _c(name: str, columns: str, grain: str = "", required: str = "", signature: str = "", **aliases: str) -> Contract:
    typed = dict(x.split(":") if ":" in x else (x, "double") for x in columns.split())
    return Contract(name, typed, tuple(grain.split()), tuple((required or grain).split()), tuple((signature or required or grain).split()), {v: k for k, vs in aliases.items() for v in vs.split("|")})


# The canonical tables.
CONTRACTS = {
    c.name: c
    for c in (
        _c("notes", "note_id:string publish_time:timestamp title:string body:string note_type:string impressions reads likes collects comments shares followers_gained note_gmv note_paid_orders note_refund_rate_pay", "note_id", "note_id", "note_id publish_time title reads", reads="read_count|views", note_id="post_id|content_id"),
        _c("products", "product_id:string product_name:string category:string series:string price_band:string launch_date:date status:string", "product_id", "product_id product_name", "product_id product_name category launch_date"),
        _c("skus", "sku_id:string product_id:string sku_name:string price inventory_optional cost_optional", "sku_id", "sku_id", "sku_id sku_name price inventory_optional", price="unit_price|list_price"),
        _c("orders", "order_id:string paid_time:timestamp sku_id:string quantity:int paid_amount refund_status_optional:string", "", "order_id paid_time sku_id quantity paid_amount", "order_id paid_time sku_id paid_amount", paid_time="payment_time|pay_time", paid_amount="amount|pay_amount", quantity="qty|units"),
        _c("comments", "note_id:string comment_time:timestamp comment_text:string", "", "note_id comment_text", "note_id comment_time comment_text", comment_text="content"),
        _c("content_features", "note_id:string composition_type:string scene_hint:string copy_angle:string purchase_motive:string", "", "note_id", "note_id composition_type copy_angle scene_hint"),
        _c("note_sku_links", "note_id:string sku_id:string link_type:string confidence", "", "note_id sku_id", "note_id sku_id link_type"),
        _c("calendar_events", "date:date event_type:string event_name:string severity:string", "", "date event_type", "date event_type event_name"),
        _c("ad_performance_daily", "date:date platform_source:string campaign_name_optional:string creative_name_optional:string spend impressions clicks orders_optional gmv_optional roas_optional", "", "date spend", "date spend impressions campaign_name_optional", spend="cost|ad_spend", clicks="click_count"),
        _c("business_overview_daily", "date:date gmv paid_orders paid_buyers aov net_gmv_pay refund_rate_pay paid_units refund_amount_pay", "date", "date gmv", "date gmv paid_orders paid_buyers aov", gmv="sales_amount|turnover"),
        _c("sku_performance", "sku_id:string sku_name:string product_id:string product_name:string category_l1:string add_to_cart_users gmv refund_rate_pay net_gmv_pay", "sku_id", "sku_id gmv", "sku_id sku_name gmv category_l1 add_to_cart_users"),
        _c("search_overview", "date:date carrier:string gmv paid_orders paid_buyers card_impression_users product_click_users product_click_rate pay_conversion", "date carrier", "", "date carrier card_impression_users product_click_users"),
        _c("search_terms", "search_term:string gmv paid_orders paid_buyers card_impression_users product_click_users", "search_term", "", "search_term card_impression_users product_click_users"),
        _c("shop_page_funnel", "date:date audience_type:string first_purchase_cycle:string shop_visitors product_click_users shop_payers", "date audience_type first_purchase_cycle", "", "audience_type first_purchase_cycle shop_visitors shop_payers"),
        _c("shop_page_source", "date:date audience_type:string first_purchase_cycle:string source_page:string shop_gmv shop_visitors enter_pay_rate gmv_per_user", "date audience_type first_purchase_cycle source_page", "", "source_page shop_gmv enter_pay_rate gmv_per_user"),
        _c("refund_overview", "stat_period:string account_type:string account_name:string carrier:string refund_amount_pay pre_ship_refund_amount post_ship_refund_amount refund_orders_pay refund_rate_pay", "stat_period account_name carrier", "", "stat_period carrier refund_amount_pay pre_ship_refund_amount"),
        _c("traffic_source", "account_id:string account_name:string channel:string note_type:string gmv paid_orders paid_buyers product_clicks", "account_id channel note_type", "", "channel note_type product_clicks account_name"),
        _c("refund_reasons", "refund_reason:string refund_amount refund_orders", "refund_reason", "", "refund_reason refund_amount refund_orders"),
    )
}
