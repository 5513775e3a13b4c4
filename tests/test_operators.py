"""Known answers and degenerate inputs of the operators, and the catalogue's queries against their SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import cleaning as C
from tallyforge.functions import statistics as S
from tallyforge.operators import bridge, compare, distribution, paid, ranks, series, structure, text, windows
from tallyforge.sources import harmonise as H
from tallyforge.sources.files import inventory


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_wilson(spark):
    lo, hi = S.wilson(F.lit(5.0), F.lit(10.0))
    zero = S.wilson(F.lit(5.0), F.lit(0.0))
    over = S.wilson(F.lit(12.0), F.lit(10.0))
    r = one(spark, lo=lo, hi=hi, z=zero[0], y=zero[1], o=over[1])
    assert (round(r.lo, 4), round(r.hi, 4), r.z, r.y) == (0.2366, 0.7634, 0.0, 0.0) and r.o == pytest.approx(1.0)


def test_erfc(spark):
    rows = spark.createDataFrame([(i / 10,) for i in range(60)], "x double").select("x", S.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) <= 1.3e-7 * math.erfc(r.x) for r in rows)


def test_two_proportion(spark):
    r = one(spark, **S.two_proportion(F.lit(30.0), F.lit(100.0), F.lit(5.0), F.lit(100.0)))
    assert r.significant and not r.ci_overlap and r.diff == pytest.approx(0.25)
    r = one(spark, **S.two_proportion(F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(0.0)))
    assert r.diff is None and not r.significant


def test_cleaning(spark):
    rows = spark.createDataFrame([("1,234",), ("¥12",), ("12%",), ("—",), ("",), ("NaN",), ("inf",), (None,), ("x",)], "v string")
    assert [r.n for r in rows.select(C.to_finite(F.col("v")).alias("n")).collect()] == [1234.0, 12.0, 12.0, None, None, None, None, None, None]
    rates = spark.createDataFrame([(0.12,), (12.0,), (1.0,), (150.0,), (-0.1,), (None,)], "v double")
    assert [r.n for r in rates.select(C.bounded_rate(F.col("v")).alias("n")).collect()] == [0.12, 0.12, 1.0, None, None, None]
    days = spark.createDataFrame([("20260401",), ("2026-04-01",), ("2026/4/1",), ("46113",), ("soon",), (None,)], "v string")
    assert [r.n for r in days.select(C.iso_day(F.col("v")).alias("n")).collect()] == ["2026-04-01"] * 4 + [None, None]
    assert one(spark, w=C.iso_week(F.lit("2027-01-01").cast("date"))).w == "2026-W53"


def test_concentration(spark):
    rows = spark.createDataFrame([("even", 1.0), ("even", 1.0), ("one", 0.0), ("one", 9.0), ("neg", -1.0), ("neg", 2.0), ("zero", 0.0)], "g string, v double")
    got = {r.g: r for r in distribution.concentration(rows, ["g"], "v").collect()}
    assert got["even"].gini == 0 and got["even"].hhi == 0.5 and got["one"].gini == 0.5 and got["neg"].gini is None and got["zero"].hhi is None


def test_trend_of_a_line_and_a_constant(spark):
    rows = spark.createDataFrame([("line", i, 2.0 * i + 1) for i in range(6)] + [("flat", i, 3.0) for i in range(6)] + [("one", 0, 5.0)], "g string, i int, v double")
    got = {r.g: r for r in series.trend_summary(rows, ["g"], "i", "v").collect()}
    assert got["line"].slope == pytest.approx(2) and got["line"].t_stat == float("inf") and got["line"].significant
    assert not got["flat"].significant and got["one"].n == 1 and got["one"].slope == 0


def brute_changepoints(v, least=3, most=3, shift=0.15):
    scale, found = abs(sum(v) / len(v)) or 1.0, []

    def cut(lo, hi):
        n = hi - lo
        if len(found) >= most or n < 2 * least:
            return
        best = max(range(least, n - least + 1), key=lambda i: (round(abs(sum(v[lo + i : hi]) / (n - i) - sum(v[lo : lo + i]) / i), 9), -i))
        d = sum(v[lo + best : hi]) / (n - best) - sum(v[lo : lo + best]) / best
        if abs(d) / scale >= shift:
            found.append(lo + best)
            cut(lo, lo + best)
            cut(lo + best, hi)

    cut(0, len(v))
    return sorted(found)


def test_changepoints_against_recursion(spark):
    r = random.Random(3)
    many = {g: [float(r.choice((10, 20, 30)) + r.random()) for _ in range(r.randint(3, 24))] for g in range(40)}
    rows = spark.createDataFrame([(g, i, x) for g, v in many.items() for i, x in enumerate(v)], "g int, i int, v double")
    got = {}
    for x in series.changepoints(rows, ["g"], "i", "v").collect():
        got.setdefault(x.g, []).append(x["index"])
    for g, v in many.items():
        assert sorted(got.get(g, [])) == brute_changepoints(v)


def test_false_discovery(spark):
    p = [("a", "x", 0.01), ("a", "y", 0.04), ("a", "z", 0.03), ("a", "n", None), ("b", "x", 0.2), ("b", "y", 0.9)]
    got = {(r.f, r.i): r.fdr_significant for r in compare.false_discovery(spark.createDataFrame(p, "f string, i string, p double"), ["f"], "p", "i").collect()}
    assert got == {("a", "x"): True, ("a", "y"): True, ("a", "z"): True, ("a", "n"): False, ("b", "x"): False, ("b", "y"): False}


def test_simpson(spark):
    strata = spark.createDataFrame([("g", 81, 87, 234, 270), ("g", 192, 263, 55, 80)], "g string, k1 int, n1 int, k2 int, n2 int")
    assert compare.stratified(strata, ["g"]).first().pooled_diff > 0


def test_bridge_adds_up(spark):
    rows = spark.createDataFrame([("s", 1, 100, 10, 500.0), ("s", 2, 120, 15, 600.0), ("s", 3, 0, 0, 0.0)], "g string, p int, visitors int, buyers int, gmv double")
    a, b = bridge.gmv_bridge(rows, ["g"], "p").orderBy("p").collect()
    assert a.delta_gmv == pytest.approx(100) and abs(a.residual) < 1e-9 and not a.partial and b.partial and b.residual == pytest.approx(-600)


def test_merge_first_value_wins_and_conflicts(spark):
    a = spark.createDataFrame([(1, 10.0, None), (2, 10.0, "x"), (3, None, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 10.3, "z"), (2, 12.5, "x"), (3, 7.0, "q"), (4, 1.0, None)], "k int, v double, s string")
    rows = H.tagged([a, b])
    assert {(r.k, r.v, r.s) for r in H.grain_merge(rows, ["k"]).collect()} == {(1, 10.0, "z"), (2, 10.0, "x"), (3, 7.0, "y"), (4, 1.0, None)}
    assert {(r.k, r.column) for r in H.merge_conflicts(rows, ["k"]).collect()} == {(2, "v"), (3, "s")}


def test_files_to_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order ID,Payment Time,SKU-ID,Qty,Amount,Extra Col\n1,2024-01-01,s,1,5,x\n")
    (tmp_path / "b.csv").write_text("Order ID,Payment Time,SKU-ID,Qty,Amount,Extra Col\n1,2024-01-01,s,1,5,x\n")
    (tmp_path / "c.csv").write_text("foo,bar\n1,2\n")
    files = inventory(spark, str(tmp_path))
    assert files.count() == 3 and files.select("digest").distinct().count() == 2
    headers = spark.createDataFrame([("a", c) for c in ("Order ID", "Payment Time", "SKU-ID", "Qty", "Amount", "Extra Col")] + [("c", "foo"), ("c", "bar")], "file string, column string")
    kinds = {r.file: (r.table_name, r.status) for r in H.classify(headers, spark).collect()}
    assert kinds["a"] == ("orders", "classified") and kinds["c"] == (None, "needs_data")
    mapped = H.map_headers(headers, H.classify(headers, spark), spark)
    assert {(r.column, r.canonical, r.how) for r in mapped.collect()} >= {("Qty", "quantity", "alias"), ("Order ID", "order_id", "exact"), ("Extra Col", "extra_col", "extra")}
    assert H.missing_required(mapped, spark).count() == 0


def test_mappings_against_a_catalog(spark):
    mapped = spark.createDataFrame([("f", "orders", h, c, how) for h, c, how in (("Qty", "quantity", "alias"), ("Amount", "paid_amount", "alias"), ("Pay Time", "paid_time", "alias"), ("X", "sku_id", "override"), ("Y", "order_id", "exact"), ("Z", "note", "fuzzy"))], "file string, table_name string, column string, canonical string, how string")
    catalog = spark.createDataFrame([("orders", "qty", "quantity", True, 1), ("orders", "amount", "gmv", True, 2), ("orders", "pay-time", "paid_time", False, 3), ("orders", "x", "gmv", True, 4)], "table_name string, header string, canonical string, approved boolean, metric_id int")
    got = {r["column"]: (r.outcome, r.accepted) for r in H.assess_mappings(mapped, catalog).collect()}
    assert got == {"Qty": ("verified", True), "Amount": ("conflict", False), "Pay Time": ("reference_only", True), "X": ("operator_confirmed", True), "Y": ("no_platform_reference", True), "Z": ("review_required", False)}
    assert {r.outcome for r in H.assess_mappings(mapped, None).collect()} == {"operator_confirmed", "catalog_unavailable"}


def test_order_lines(spark):
    rows = spark.createDataFrame([("1", "s", "2", "¥5"), ("", "s", "2", "5"), ("2", "s", "1.5", "5"), ("3", "s", "1", "-1"), ("4", None, "1", "1")], "order_id string, sku_id string, quantity string, paid_amount string")
    good, bad = H.validate_orders(rows)
    assert [r.order_id for r in good.collect()] == ["1"] and bad.count() == 4
    with pytest.raises(Exception, match="missing|whole|finite"):
        H.validate_orders(rows, strict=True)[1].collect()


def test_windows_at_their_ends(spark):
    from datetime import date, timedelta

    day = date(2024, 3, 1)
    anchors = spark.createDataFrame([(1, "a", "s", day), (1, "b", "none", day)], "shop_id int, note_id string, sku_id string, publish_day date")
    sales = spark.createDataFrame([(1, "s", day + timedelta(g), 1.0) for g in (-7, -1, 0, 1, 3, 4, 8, 14, 15)], "shop_id int, sku_id string, day date, units double")
    got = {r.note_id: r for r in windows.response_windows(anchors, sales).collect()}
    assert (got["a"].d0_1_units, got["a"].d1_3_units, got["a"].d4_7_units, got["a"].d8_14_units) == (1, 2, 1, 2) and got["b"].matched_sales_days == 0
    assert windows.anchored_lift(anchors, sales).count() == 8


def test_global_rank_matches_window(spark):
    rows = spark.range(1000).select(F.col("id"), (F.xxhash64("id") % 50).cast("double").alias("v"))
    got = {r.id: (r.rank, r.running) for r in ranks.global_rank(rows, [F.desc("v"), F.asc("id")], "v", 7).collect()}
    total = 0.0
    for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.v, r.id))):
        total += r.v
        assert got[r.id] == (i + 1, pytest.approx(total))


def test_ranked_in_groups_across_partitions(spark):
    group = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string"))
    rows = spark.range(900).select("id", group.alias("g"), (F.xxhash64("id") % 20).cast("double").alias("v"))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((r.v, r.id))
    for n in (1, 7, 64):
        got = {r.id: (r._rank, r._size, r._running, r._total) for r in ranks.ranked(rows, ["g"], [F.asc("v"), F.asc("id")], "v", n).collect()}
        assert len(got) == 900
        for members in groups.values():
            run = 0.0
            for i, (v, key) in enumerate(sorted(members)):
                run += v
                assert got[key] == (i + 1, len(members), pytest.approx(run), pytest.approx(sum(m[0] for m in members)))


def test_quantile_edges_match_percentile(spark):
    rows = spark.range(700).select((F.col("id") % 4).alias("g"), F.when(F.col("id") % 11 != 0, (F.xxhash64("id") % 30) / 7).alias("v")).unionByName(spark.createDataFrame([(9, 1.0), (9, 2.0)], "g long, v double"))
    want = {r.g: r.e for r in rows.groupBy("g").agg(F.percentile("v", F.array(*(F.lit(i / 5) for i in range(5)))).alias("e")).collect()}
    got = {r.g: r.edges for r in distribution.quantile_edges(rows, ["g"], "v", 5).collect()}
    assert set(got) == {0, 1, 2, 3} and all(got[g] == pytest.approx(want[g]) for g in got)
    whole = distribution.quantile_edges(rows, [], "v", 4).first().edges
    assert whole == pytest.approx(rows.select(F.percentile("v", F.array(*(F.lit(i / 4) for i in range(4))))).first()[0])
    assert distribution.quantile_edges(rows.where("v > 99"), [], "v").count() == 0


def test_text(spark):
    docs = spark.createDataFrame([(1, "abcx"), (2, "abcy"), (3, ""), (4, None), (5, "12")], "id int, t string")
    terms = {r.term for r in text.themes(docs, "id", "t").collect()}
    assert terms == {"abc"}  # ab and bc lie in it with as many documents
    assert one(spark, p=text.polarity(F.lit("good good bad"), ("good",), ("bad",)), z=text.polarity(F.lit(""), ("a",), ("b",))).asDict() == {"p": pytest.approx(1 / 3), "z": 0.0}


def test_nested_windows(spark):
    rows = spark.createDataFrame([("a", "180 days", 1), ("a", "365 days", 2), ("b", "180 days", 3), ("a", "all", 9)], "g string, c string, n int")
    assert {(r.g, r.n) for r in structure.widest_window(rows, ["g"], "c", "all").collect()} == {("a", 2), ("b", 3)}


def test_budget_action(spark):
    rows = [(500.0, 50, 2000.0, 4.0, 5, "increase"), (500.0, 50, 200.0, 0.4, 5, "reduce"), (500.0, 5, 2000.0, 4.0, 5, "hold"), (None, 50, 1.0, 1.0, 5, "needs_data")]
    df = spark.createDataFrame(rows, "s double, c int, g double, r double, d int, want string")
    assert df.where(paid.budget_action(F.col("s"), F.col("c"), F.col("g"), F.col("r"), F.col("d")) != F.col("want")).count() == 0


def test_same_result_under_any_partitions(spark):
    found = set()
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = spark.range(500).select((F.col("id") % 7).alias("g"), F.col("id").alias("i"), (F.col("id") * 37 % 101).cast("double").alias("v"))
        found.add(tuple((r.g, round(r.gini, 9), round(r.hhi, 9)) for r in distribution.concentration(rows, ["g"], "v").orderBy("g").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == 1


def test_top_rows_of_groups(spark):
    from tallyforge.operators.ranks import top_rows

    rows = [(k, i % 40, i) for k in ("hot", "a", None) for i in range(300 if k == "hot" else 5)]
    got = top_rows(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), F.asc("i")], 4, parts=7).collect()
    for k in ("hot", "a", None):
        want = sorted(((v, i) for x, v, i in rows if x == k), key=lambda x: (-x[0], x[1]))[:4]
        assert [(r.v, r.i) for r in sorted((r for r in got if r.k == k), key=lambda r: r["_rank"])] == want


def test_any_prefixes(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "day int, live_gmv double, live_net_gmv double, video_card_gmv double, other double")
    got = {(r.carrier, r.gmv, r.net_gmv) for r in structure.unpivot_prefixes(df, ["day"], ["gmv", "net_gmv"]).collect()}
    assert got == {("live", 2.0, 3.0), ("video_card", 4.0, None)}


def test_quantiles_of_groups(spark):
    from tallyforge.operators.distribution import describe, quantiles

    rows = [("a", float(i)) for i in range(101)] + [("b", 7.0), ("b", None), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.quantiles for r in quantiles(df, ["k"], "v", (0.1, 0.5, 1.0)).collect()}
    assert got == {"a": [10.0, 50.0, 100.0], "b": [7.0, 7.0, 7.0], None: [1.1, 1.5, 2.0]}
    said = {r.k: (r.n, r.median, r.iqr) for r in describe(df, ["k"], "v").collect()}
    assert said == {"a": (101, 50.0, 50.0), "b": (1, 7.0, 0.0), None: (2, 1.5, 0.5)}


def test_ratios_of_rows(spark):
    bands = [(0.078, 0.083, "约 7.8%–8.3%"), (0.0781, 0.0783, "约 7.81%–7.83%"), (0.1, 0.2, "约 10%–20%"), (0.08, 0.08, "约 8%"), (0.08, 0.080001, "约 8%"), (None, 0.1, None)]
    got = spark.createDataFrame(bands, "low double, high double, want string").select(C.rate_band(F.col("low"), F.col("high")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    rows = spark.createDataFrame([(1.0, 0.0), (6.0, 2.0), (None, 2.0), (6.0, None), (float("nan"), 2.0), (6.0, -1.0)], "g double, v double")
    r = rows.select(C.per_visitor_gmv(F.col("g"), F.col("v")).alias("p"), C.share_of(F.col("g"), F.col("v")).alias("s"), C.net_gmv(F.col("g"), F.col("v")).alias("n")).collect()
    assert [x.p for x in r] == [None, 3.0, None, None, None, None]
    assert [x.s for x in r][:4] == [None, 3.0, None, None] and [x.n for x in r][:4] == [1.0, 4.0, None, None]


def test_ratios_of_absent_columns(spark):
    note = C.note_ratios(spark.createDataFrame([(10.0, 2, None), (0.0, 1, 1)], "reads double, likes int, collects int")).collect()
    assert [(r.read_rate, r.like_rate, r.collect_rate, r.comment_rate, r.engagement_rate, r.click_to_order, r.gmv_per_click) for r in note] == [(None, 0.2, 0.0, 0.0, 0.2, None, None), (None,) * 7]
    ad = C.ad_ratios(spark.createDataFrame([(10.0, 4)], "spend double, clicks int")).first()
    assert (ad.cpc_calc, ad.ctr_calc, ad.cpm_calc, ad.cvr_calc, ad.cost_per_order_calc, ad.roas_calc) == (2.5, None, None, None, None, None)
