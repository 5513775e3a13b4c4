"""All tasks over one workspace: shared marts, the same results as from the folder, gaps instead of errors."""

import re

import pytest

from tallyforge.plans import ALL
from tallyforge.sources.workspace import Workspace
from tallyforge.tasks.registry import TASKS, coverage, run_task, run_tasks

SF = "/root/testdata/sf0.001"
NAMES = ("lineitem", "orders", "part", "events", "supplier", "nation", "conversations")


def read(spark, **without):
    out = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in NAMES}
    return {n: df.drop(*without.get(n, "").split()) for n, df in out.items()}


@pytest.fixture(scope="module")
def shared(spark):
    return Workspace(spark, SF)


def rows(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def test_one_join_for_all(spark, shared):
    """Order lines and orders meet in the stored mart alone, whatever runs after it."""
    found = run_tasks(shared)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for t in found.values() for df in t.values()]
    assert len(plans) > 100 and not [p for p in plans if re.search(r"Join.*l_orderkey#\w+ = o_orderkey", p)]
    assert {"order_lines", "daily", "perf", "sku_days", "traffic", "note_funnel", "ads"} <= set(shared.marts)


@pytest.mark.parametrize("query", ["core_snapshot", "anchored_lift", "sku_net_rows", "paid_hierarchy", "search_leaks", "carrier_days"])
def test_same_as_from_a_folder(spark, shared, query):
    assert rows(ALL[query].run(spark, shared)) == rows(ALL[query].run(spark, SF))


def test_absent_columns(spark):
    w = Workspace(spark, read(spark, lineitem="l_returnflag", orders="o_custkey", part="p_size"))
    core = run_task("core_business_diagnosis", w)
    status = {r.result: r for r in core["status"].collect()}
    assert set(core) == {"depth", "funnel", "status"} and core["depth"].count() == 1
    assert not status["snapshot"].judgable and status["snapshot"].reason == "missing: order_lines.buyer_id, order_lines.refunded"
    assert set(run_task("product_opportunity_matrix", w)) == {"status"}
    assert set(run_task("account_baseline", w)) == {"days", "windows", "slots", "status"}


def test_absent_table(spark):
    tables = read(spark)
    del tables["conversations"]
    found = {r.task_id: r for r in coverage(Workspace(spark, tables), ("comment_demand_mining", "cover_style_effect", "data_quality_check")).collect()}
    assert not found["comment_demand_mining"].producible and "missing: conversations.*" in found["comment_demand_mining"].reasons
    assert found["cover_style_effect"].producible and found["cover_style_effect"].reasons is None


def test_no_rows(spark):
    tables = {n: df.limit(0) for n, df in read(spark).items()}
    got = coverage(Workspace(spark, tables), ("note_funnel", "refund_root_cause_diagnosis")).collect()
    assert [(r.task_id, r.producible) for r in got] == [("note_funnel", True), ("refund_root_cause_diagnosis", False)]
    assert "bands: no rows" in got[1].reasons


def test_unknown(shared):
    with pytest.raises(KeyError):
        run_task("nothing", shared)
    assert len(TASKS) == 26


def test_from_exports(spark, tmp_path):
    """A folder of exports, built and analysed: what it holds is judged, what it lacks is said."""
    from tallyforge.sources.bindings import from_contracts
    from tallyforge.sources.build import build_tables

    src = tmp_path / "in"
    src.mkdir()
    (src / "orders.csv").write_text("order_id,sku_id,paid_time,quantity,paid_amount,refund_status_optional\n" + "".join(f"o{i},s{i % 3},2024-01-{i % 20 + 1:02d},{i % 3 + 1},{i},{'refunded' if i % 5 == 0 else ''}\n" for i in range(60)))
    (src / "notes.csv").write_text("note_id,publish_time,impressions,reads,collects,comments,note_gmv,note_paid_orders\n" + "".join(f"n{i},2024-01-0{i + 1} 10:00:00,{100 * i},{50 + i},{i},{i},{9 * i},{i}\n" for i in range(6)))
    (src / "links.csv").write_text("note_id,sku_id,link_type\nn1,s1,main\nn2,s0,main\n")
    (src / "days.csv").write_text("date,gmv,paid_orders,paid_buyers,aov,paid_units,refund_amount_pay\n" + "".join(f"202401{i + 1:02d},{100 + i},{10 + i},{9 + i},{10},{12},{i}\n" for i in range(20)))
    (src / "features.csv").write_text("note_id,composition_type,copy_angle,scene_hint\nn1,close,gift,home\nn2,wide,daily,home\n")
    build_tables(spark, str(src), str(tmp_path / "out"))
    w = from_contracts(spark, str(tmp_path / "out"))
    lift = run_task("sku_counterfactual_lift", w)
    d0 = {r.note_id: (r.pre_units, r.post_units) for r in lift["windows"].where("window = 'd0_1'").collect()}
    assert d0 == {"n1": (0.0, 2.0), "n2": (1.0, 1.0)}
    core = run_task("core_business_diagnosis", w)
    assert core["snapshot"].first().gmv == sum(100 + i for i in range(20)) and core["snapshot"].first().paid_buyer_days == sum(9 + i for i in range(20))
    status = {r.result: r.reason for r in core["status"].collect()}
    assert status["trend"] is None and "buyer_id" in status["bridge"] and status["depth"].startswith("missing: events.")
    effects = run_task("cover_style_effect", w)
    assert {r.style: (r.notes, r.matched_notes, r.views) for r in effects["effects"].collect()} == {"close": (1, 1, 100), "wide": (1, 1, 200)}
    lacks = {r.result: r.reason for r in run_task("note_funnel", w)["status"].collect()}
    assert lacks == {"totals": "missing: note_funnel.refunds", "notes": None, "bars": None}
