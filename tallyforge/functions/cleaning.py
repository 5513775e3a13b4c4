"""Column expressions that clean exported values. Each gives null where the value can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks dropped from numbers, and what stands for a missing value.
NUMBER_MARKS = ",，¥￥$% \t"
MISSING = ("", "-", "--", "—", "N/A", "n/a", "nan", "None", "null")
DAY_PARTS = ((5, 11, "morning"), (11, 14, "noon"), (14, 18, "afternoon"), (18, 22, "evening"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def to_finite(c: Column) -> Column:
    """A number from text such as '1,234' or '12%' (percent signs don't rescale)."""
    text = F.trim(c.cast("string"))
    number = F.translate(text, NUMBER_MARKS, "").try_cast("double")
    return F.when(~text.isin(*MISSING) & (F.abs(number) < float("inf")), number)  # NaN is above all numbers


def bounded_rate(c: Column) -> Column:
    """A rate as a fraction: above 1 and up to 100 is a percentage; negative or larger is dirty."""
    return F.when((c >= 0) & (c <= 1), c).when((c > 1) & (c <= 100), c / 100)


def ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive."""
    return F.when(d > 0, n / d)


def number_or_null(df: DataFrame, name: str) -> Column:
    """The column as a number, or null if the table lacks it; decided when the plan is made."""
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def text_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("unknown"))


def parse_day(c: Column) -> Column:
    """A date from YYYYMMDD, ISO or slashed text, or a spreadsheet's day number (20000 to 60000)."""
    text = F.substring(F.trim(c.cast("string")), 1, 10)
    serial = F.when(text.rlike("^[2-5][0-9]{4}$"), text.try_cast("int"))
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy/M/d"), F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")), F.expr("date'1899-12-30'") + serial)


def is_missing(c: Column) -> Column:
    """Null, or text of blanks alone."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def optional_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def parse_quantity(c: Column) -> Column:
    """A whole number, written with or without grouping commas or a fraction of zeros."""
    number = to_finite(c)
    return F.when(number % 1 == 0, number.try_cast("long"))


#: A date with or without a time and a zone, and a spreadsheet's day number with or without a part of a day.
_MOMENT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?: ?Z|[+-][0-9]{2}:[0-9]{2})?)?$"
_SERIAL = r"^[0-9]{5}(?:\.[0-9]+)?$"


def parse_timestamp(c: Column) -> Column:
    """A timestamp from ISO or slashed text with its time, YYYYMMDD, or a spreadsheet's day number from 20000 to 60000 with its part of a day.

    Times without a zone are of the session's; a day number is rounded to milliseconds.
    """
    text = F.replace(F.trim(c.cast("string")), F.lit("/"), F.lit("-"))
    serial = F.when(text.rlike(_SERIAL), text.try_cast("double"))
    days = F.floor(serial)
    seconds = F.round((serial - days) * 86400, 3).cast("decimal(18,6)")
    moved = F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), seconds)
    compact = F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd").cast("timestamp"))
    return F.coalesce(F.when(text.rlike(_MOMENT), text.try_cast("timestamp")), F.when(serial.between(20000, 60000), moved.cast("timestamp")), compact)


def iso_day(c: Column) -> Column:
    return F.date_format(parse_day(c), "yyyy-MM-dd")


def iso_week(day: Column) -> Column:
    """YYYY-Www by the ISO year, which isn't the calendar year at its ends."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def period_month(c: Column) -> Column:
    text = F.regexp_replace(F.trim(c.cast("string")), "/", "-")
    spliced = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2))
    return F.when(F.instr(text, "-") > 0, F.substring(text, 1, 7)).when(text.rlike("^[0-9]{8}$"), spliced)


def month_end(period: Column) -> Column:
    """Last day of a YYYY-MM period as the integer YYYYMMDD."""
    return F.date_format(F.last_day(F.to_date(F.concat(period, F.lit("-01")))), "yyyyMMdd").cast("int")


def day_part(hour: Column) -> Column:
    out = F.lit("night")
    for lo, hi, name in DAY_PARTS:
        out = F.when((hour >= lo) & (hour < hi), name).otherwise(out)
    return out


def pct_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, (new - old) / old)


def direction(delta: Column, eps: float = 1e-9) -> Column:
    return F.when(delta > eps, "up").when(delta < -eps, "down").otherwise("flat")


def stable_id(seed: Column) -> Column:
    return F.concat(F.lit("h_"), F.substring(F.sha1(seed), 1, 10))


def percentile_label(p: Column) -> Column:
    return F.when(p.isNotNull(), F.concat(F.lit("P"), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(p * 100).cast("int"))).cast("string")))


def net_gmv(gmv: Column, refund: Column) -> Column:
    """What is left of an amount; null where either isn't known."""
    return gmv - refund


def share_of(part: Column, whole: Column) -> Column:
    """part / whole for refunded amounts and orders; null where the whole is 0 or either isn't known."""
    return part / F.nullif(whole, F.lit(0).cast("double"))


def per_visitor_gmv(gmv: Column, visitors: Column) -> Column:
    """Amount for each product visitor; null for counts of 0 or less and what isn't finite."""
    return F.when(is_finite(gmv) & is_finite(visitors) & (visitors > 0), gmv / visitors)


def rate_band(low: Column, high: Column) -> Column:
    """Two rates as "约 7.8%–8.3%", with none, one or two decimals: the fewest that keep them apart; one rate if none does."""
    shown = lambda c, d: F.format_string(f"%.{d}f", (c * 100).cast("double"))
    band = lambda d: F.concat(F.lit("约 "), shown(low, d), F.lit("%–"), shown(high, d), F.lit("%"))
    out = F.concat(F.lit("约 "), shown(high, 0), F.lit("%"))
    for d in (2, 1, 0):
        out = F.when(shown(low, d) != shown(high, d), band(d)).otherwise(out)
    return F.when(low.isNotNull() & high.isNotNull(), out)


def note_ratios(df: DataFrame) -> DataFrame:
    """df with seven ratios of each note; reactions that the table lacks count as none, other columns that it lacks give null."""
    n = lambda c: number_or_null(df, c)
    reaction = lambda c: F.coalesce(n(c), F.lit(0.0))
    likes, collects, comments = (reaction(c) for c in ("likes", "collects", "comments"))
    return df.withColumns({
        "read_rate": ratio(n("reads"), n("impressions")), "like_rate": ratio(likes, n("reads")), "collect_rate": ratio(collects, n("reads")), "comment_rate": ratio(comments, n("reads")),
        "engagement_rate": ratio(likes + collects + comments + reaction("shares"), n("reads")),
        "click_to_order": ratio(n("note_paid_orders"), n("product_clicks")), "gmv_per_click": ratio(n("note_gmv"), n("product_clicks")),
    })


def ad_ratios(df: DataFrame) -> DataFrame:
    """df with six ratios of each ad row; columns that the table lacks give null."""
    n = lambda c: number_or_null(df, c)
    return df.withColumns({
        "ctr_calc": ratio(n("clicks"), n("impressions")), "cpc_calc": ratio(n("spend"), n("clicks")), "cpm_calc": ratio(n("spend") * 1000, n("impressions")), "cvr_calc": ratio(n("conversions_optional"), n("clicks")),
        "cost_per_order_calc": ratio(n("spend"), n("orders_optional")), "roas_calc": ratio(n("gmv_optional"), n("spend")),
    })


def reconciles(stated: Column, computed: Column, tolerance: float = 0.05) -> Column:
    """Whether a stated amount agrees with the computed one within a share of the computed."""
    return F.when(computed == 0, stated == 0).otherwise(F.abs(stated - computed) <= F.abs(computed) * tolerance)


def threshold_bar(value: Column, bar: Column) -> Column:
    return F.when(value.isNull() | bar.isNull(), "not_judgable").when(value > bar, "above").when(value < bar, "below").otherwise("at")
