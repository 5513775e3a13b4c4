"""Streams against their batch forms, in any order of files, with late rows, retries and bounded state."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming import marts, partials, responses, sales

LINE = "shop_id long, day date, sku_id long, order_id long, units double, gmv double"


def folder_stream(spark, batches, schema, path, per=1):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", per).parquet(path)


def order_lines(n=400, seed=1):
    r = random.Random(seed)
    return [(r.randint(0, 1), date(2024, 1, 1) + timedelta(days=r.randint(0, 29)), r.randint(1, 4), r.randint(1, 150), float(r.randint(1, 5)), float(r.randint(1, 90))) for _ in range(n)]


def by_day(rows):
    out = {}
    for shop, day, sku, order, units, gmv in rows:
        x = out.setdefault((shop, day, sku), [0.0, 0.0, set()])
        x[0] += units
        x[1] += gmv
        x[2].add(order)
    return {k: (u, g, len(o)) for k, (u, g, o) in out.items()}


def found_days(spark, folder):
    return {(x.shop_id, x.day, x.sku_id): (x.units, x.gmv, x.order_count) for x in sales.sku_days(spark, folder).collect()}


def test_sales_in_any_order(spark, tmp_path, seed=1):
    rows = order_lines(seed=seed)
    random.Random(seed).shuffle(rows)
    batches = [rows[i::3] for i in range(3)]
    folder = marts.run_available(folder_stream(spark, batches, LINE, f"{tmp_path}/s"), "sales", "append", sales.sales_epoch(40))
    assert found_days(spark, folder) == by_day(rows) and sales.late_rows(spark, folder).count() == 0


def test_late_sales(spark, tmp_path):
    rows = sorted(order_lines(), key=lambda x: x[1])
    batches = [rows[:200], rows[200:380], [rows[0], rows[5], (0, None, 1, 1, 1.0, 1.0)], rows[380:], []]
    folder = marts.run_available(folder_stream(spark, batches, LINE, f"{tmp_path}/s"), "sales", "append", sales.sales_epoch(3))
    assert found_days(spark, folder) == by_day(rows)
    assert sorted(map(tuple, sales.late_rows(spark, folder).collect()), key=str) == sorted([rows[0], rows[5], batches[2][2]], key=str)
    last = partials.last_commit(spark, folder)
    kept = spark.read.parquet(f"{folder}/orders/{last.epoch}/closed=false").agg(F.min("day")).first()[0]
    assert last.told["closed"] == str(rows[-1][1] - timedelta(days=3)) and kept >= rows[-1][1] - timedelta(days=3)


def test_retried_sales_epoch(spark, tmp_path):
    each, rows = sales.sales_epoch(2), order_lines()
    frames = [spark.createDataFrame(rows[i::3], LINE) for i in range(3)]
    each(frames[0], 0, str(tmp_path))
    frames[1].write.parquet(f"{tmp_path}/orders/1/closed=true")  # what a stopped epoch left
    for i in (1, 1, 2, 2, 0):
        each(frames[i], i, str(tmp_path))
    late = sales.late_rows(spark, str(tmp_path)).count()
    kept = sum(1 for r in rows) - late
    assert late > 0 and partials.last_commit(spark, str(tmp_path)).epoch == 2
    assert sum(x.units for x in sales.sku_days(spark, str(tmp_path)).collect()) == pytest.approx(sum(r[4] for r in rows) - sales.late_rows(spark, str(tmp_path)).agg(F.sum("units")).first()[0])
    assert kept > 0


def value_rows(n, seed=3):
    r = random.Random(seed)
    return [(r.randint(1, n // 3), i, r.choice([None, "a", "b"]), r.choice([None, r.randint(1, 9)])) for i in range(n)]


def first_by_key(rows):
    out = {}
    for k, at, a, b in sorted(rows, key=lambda x: x[1]):
        x = out.setdefault(k, [at, None, None])
        x[1], x[2] = x[1] if x[1] is not None else a, x[2] if x[2] is not None else b
    return {k: tuple(v) for k, v in out.items()}


def test_merge_in_any_order(spark, tmp_path, seed=1):
    rows = value_rows(300)
    mixed = random.Random(seed).sample(rows, len(rows))
    stream = folder_stream(spark, [mixed[i::4] for i in range(4)], "k long, at long, a string, b long", f"{tmp_path}/s")
    folder = marts.run_available(stream, "merge", "append", partials.merge_epoch(["k"], "at"))
    got = {x.k: (x["at"], x.a, x.b) for x in partials.merged(spark, folder, ["k"], "at", ["a", "b"]).collect()}
    assert got == first_by_key(rows)
    want = {(k, c) for k in got for c, i in (("a", 2), ("b", 3)) if len({r[i] for r in rows if r[0] == k} - {None}) > 1}
    assert {tuple(x) for x in partials.conflicts(spark, folder, ["k"], "at", ["a", "b"]).collect()} == want


def test_writes_follow_the_epochs(spark, tmp_path):
    """A small epoch after a large one writes its own rows, and parts stay few."""
    each, folder = partials.merge_epoch(["k"], "at"), str(tmp_path)
    each(spark.range(20_000).select(F.col("id").alias("k"), F.col("id").alias("at"), F.lit("x").alias("a")), 0, folder)
    for e in range(1, 6):
        each(spark.range(10).select((F.col("id") * 1999).alias("k"), (F.col("id") - e).alias("at"), F.lit(f"y{e}").alias("a")), e, folder)
        written = sum(p.stat().st_size for p in tmp_path.glob(f"parts/{e}-*/*.parquet"))
        assert written < 40_000
    assert len(partials.last_commit(spark, folder).parts) <= 5
    got = {x.k: x.a for x in partials.merged(spark, folder, ["k"], "at", ["a"]).where("k < 19000").collect()}
    assert len(got) == 19_000 and {k for k, a in got.items() if a == "y5"} == set(range(0, 19_000, 1999)) and got[1] == "x"



def test_stopped_and_retried_epoch(spark, tmp_path):
    each, folder, schema = partials.merge_epoch(["k"], "at"), str(tmp_path), "k long, at long, a string"
    with pytest.raises(LookupError):
        partials.read(spark, folder, partials.merge_first(["k"], "at", ["a"]))
    each(spark.createDataFrame([(1, 5, "x")], schema), 0, folder)
    spark.createDataFrame([(9, 9, "left")], schema).write.parquet(f"{folder}/parts/1-0")  # stopped before its commit
    seen = lambda: {x.k: x.a for x in partials.merged(spark, folder, ["k"], "at", ["a"]).collect()}
    assert seen() == {1: "x"}
    for _ in range(2):
        each(spark.createDataFrame([(1, 4, "w"), (2, 6, None)], schema), 1, folder)
        assert seen() == {1: "w", 2: None}


def test_response_windows(spark, tmp_path, salts=2):
    r, begin = random.Random(4), datetime(2024, 1, 1)
    rows = [("a", f"n{i}", r.randint(1, 3), begin + timedelta(days=r.randint(0, 40)), 0.0) for i in range(40)]
    rows += [("s", "", r.randint(1, 3), begin + timedelta(days=r.randint(0, 60)), float(r.randint(1, 9))) for _ in range(150)]
    rows.append(("a", "alone", 9, begin, 0.0))
    r.shuffle(rows)
    batches = [rows[i::2] for i in range(2)] + [[("a", "end", -1, datetime(2100, 1, 1), 0.0), ("s", "", -2, datetime(2100, 1, 1), 0.0)]]
    stream = folder_stream(spark, batches, "kind string, note_id string, sku long, ts timestamp, units double", f"{tmp_path}/s")
    anchors = stream.where("kind = 'a'").select("sku", "note_id", F.col("ts").alias("publish_ts"))
    sold = stream.where("kind = 's'").select("sku", F.col("ts").alias("sale_ts"), "units")
    progress = []
    out = f"{tmp_path}/out"
    q = (
        responses.response_windows(anchors, sold, ["sku"], "90 days", salts).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True).foreachBatch(lambda b, e: marts.append_epoch(b, e, out)).start()
    )
    q.awaitTermination()
    progress = q.recentProgress
    got = {x.note_id: (x.d0_1_units, x.d1_3_units, x.d4_7_units, x.d8_14_units, x.matched_sales_days) for x in spark.read.parquet(f"{out}/rows/epoch=*").collect()}
    want = {}
    for _, note, sku, ts, _ in (x for x in rows if x[0] == "a"):
        gaps = [((s[3] - ts).days, s[4]) for s in rows if s[0] == "s" and s[2] == sku and s[3] >= ts]
        sums = tuple(sum(u for g, u in gaps if lo <= g < hi) for lo, hi in responses.WINDOWS.values())
        want[note] = (*sums, len({g for g, _ in gaps if g < 15}))
    assert got == want and got["alone"] == (0.0, 0.0, 0.0, 0.0, 0)
    state = progress[-1]["stateOperators"]
    assert sum(s["numRowsTotal"] for s in state) <= 2 + salts and sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]) == 0


def test_slices_of_days():
    d = lambda n: date(2024, 1, n)
    days = [(None, None, 9), (2023, date(2023, 12, 31), 4), (2024, d(1), 3), (2024, d(2), 3), (2024, d(5), 5), (2024, d(6), 20), (2024, d(7), 1)]
    assert marts.slices(days, 10) == [(None, None, None), (2023, date(2023, 12, 31), date(2023, 12, 31)), (2024, d(1), d(2)), (2024, d(5), d(5)), (2024, d(6), d(6)), (2024, d(7), d(7))]
    assert marts.slices(days)[2:] == [(2024, d(1), d(7))] and marts.slices([]) == []


@pytest.mark.parametrize("most", [30, 10**6])
def test_replay_computes_rows_once_in_epochs_of_slices(spark, most):
    seen, epochs = spark.sparkContext.accumulator(0), []
    rows = [(i, date(2023, 12, 20) + timedelta(days=i % 40)) for i in range(200)] + [(200, None)]

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "id long, day date").mapInPandas(count, "id long, day date")
    stream = marts.replayed(df, "day", "test", last=lambda x: x.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("2999-01-01").cast("date").alias("day")))
    stream = marts.replayed(df, "day", "test", most=most) if most < 100 else stream
    marts.run_available(stream, "test", "append", lambda b, e, f: epochs.append([tuple(r) for r in b.collect()]))
    got = [r for e in epochs for r in e]
    assert sorted(r[0] for r in got if r[0] >= 0) == list(range(201)) and seen.value == 201 * (2 if most < 100 else 1)
    assert [e for e in epochs if (200, None) in e] == [[(200, None)]] and ((-1, date(2999, 1, 1)) in epochs[-1]) == (most > 100)
    dated = [e for e in epochs if (200, None) not in e]
    assert len(dated) == (3 if most > 100 else 7) and all(max(d for _, d in a) < min(d for _, d in b) for a, b in zip(dated, dated[1:], strict=False))


def test_closed_days_orders_are_not_written(spark, tmp_path):
    rows = order_lines()
    sales.sales_epoch(2)(spark.createDataFrame(rows, LINE), 0, str(tmp_path))
    left = max(r[1] for r in rows) - timedelta(days=2)
    assert {p.name for p in (tmp_path / "orders/0").iterdir()} == {"closed=false"}
    assert spark.read.parquet(f"{tmp_path}/orders/0").agg(F.min("day")).first()[0] == left and found_days(spark, str(tmp_path)) == by_day(rows)


ANCHORED = "sku long, note_id string, day date, units double, sold boolean"


def anchored(n=300, seed=6):
    """Anchors, sales, rows that are both; null keys and units, and anchors that come twice."""
    r, begin = random.Random(seed), date(2024, 1, 1)
    rows = [(r.choice([1, 1, 2, 3, None]), r.choice([None, f"n{i}"]), begin + timedelta(days=r.randint(0, 60)), r.choice([None, 1.0, 2.0, 5.0]), r.random() < 0.7) for i in range(n)]
    return rows + [rows[i] for i in range(0, n, 9)] + [(9, "alone", begin, 4.0, False)]


def sums_by_day(rows):
    """Each anchor's sums, by hand; a row that comes twice is two anchors of one name."""
    out = {}
    for sku, note, day, _, _ in rows:
        if note is not None:
            near = [((d - day).days, u) for s, _, d, u, sold in rows if sold and s is not None and s == sku and 0 <= (d - day).days < responses.LAST]
            x = out.setdefault((sku, note, day), [0.0, 0.0, 0.0, 0.0, len({g for g, _ in near})])
            for i, (low, high) in enumerate(responses.WINDOWS.values()):
                x[i] += sum(u or 0.0 for g, u in near if low <= g < high)
    return {k: tuple(v) for k, v in out.items()}


def sent(spark, folder):
    got = [((x.sku, x.note_id, x.day), (x.d0_1_units, x.d1_3_units, x.d4_7_units, x.d8_14_units, x.matched_sales_days)) for x in responses.sent(spark, folder).collect()]
    assert len(got) == len(dict(got))
    return dict(got)


FAR = (-1, "far", date(2999, 1, 1), 1.0, True)


@pytest.mark.parametrize("task_rows", [50, 500_000])
def test_responses_by_epochs_in_any_order(spark, tmp_path, monkeypatch, task_rows):
    monkeypatch.setattr("tallyforge.sources.staging.TASK_ROWS", task_rows)
    monkeypatch.setattr(responses, "TASK_ROWS", task_rows)
    rows = anchored()
    random.Random(1).shuffle(rows)
    stream = folder_stream(spark, [rows[i::3] for i in range(3)] + [[FAR]], ANCHORED, f"{tmp_path}/s")
    folder = marts.run_available(stream, "responses", "append", responses.responses_epoch(["sku"], 90))
    assert sent(spark, folder) == sums_by_day(rows)
    assert [tuple(r)[:5] for r in spark.read.parquet(f"{folder}/open/{partials.last_commit(spark, folder).epoch}").collect()] == [FAR]


def test_late_and_retried_responses(spark, tmp_path):
    rows, folder = sorted(anchored(), key=lambda x: x[2]), str(tmp_path)
    with pytest.raises(LookupError):
        responses.sent(spark, folder)
    late = [rows[0], (1, "late", date(2024, 1, 2), 1.0, True), (1, "undated", None, 1.0, True)]
    batches, each = [rows[:150], rows[150:250], [], late, rows[250:], [FAR]], responses.responses_epoch(["sku"], 3)
    frames = [spark.createDataFrame(b, ANCHORED) for b in batches]
    for i in range(6):
        each(frames[i], i, folder)
        closed = (max(r[2] for r in rows[: (150, 250, 250, 250, len(rows))[i]]) if i < 5 else FAR[2]) - timedelta(days=3)
        kept = spark.read.parquet(f"{folder}/open/{i}")
        assert partials.last_commit(spark, folder).told["closed"] == str(closed) and kept.agg(F.min("day")).first()[0] > closed - timedelta(days=responses.LAST)
        before = sent(spark, folder)
        assert all(k[2] + timedelta(days=responses.LAST) <= closed for k in before)
        each(frames[i], i, folder)  # run again
        each(frames[0], 0, folder)
        assert sent(spark, folder) == before
    assert before == sums_by_day(rows)
    assert sorted(map(tuple, spark.read.schema(ANCHORED).parquet(f"{folder}/late/epoch=3").collect()), key=str) == sorted(late, key=str)
    spark.createDataFrame([(1, "left", date(2024, 1, 1), 0.0, 0.0, 0.0, 0.0, 0)], spark.read.parquet(f"{folder}/rows/epoch=0").schema).write.parquet(f"{folder}/rows/epoch=6")  # stopped before its commit
    assert sent(spark, folder) == before


def test_replay_of_no_rows(spark):
    empty = spark.createDataFrame([], ANCHORED)
    stream = marts.replayed(empty, "day", "empty", last=lambda x: x.limit(1))
    assert responses.sent(spark, marts.run_available(stream, "empty", "append", responses.responses_epoch(["sku"], 3))).count() == 0


def test_replay_keeps_files_in_order_of_days(spark):
    """A file for each task, not for each task and year, sorted, so that a slice reads little else."""
    rows = [(i, date(2022, 1, 1) + timedelta(days=i * 37 % 900)) for i in range(300)]
    paths = {p for p in Path(marts.shared_dir(spark)).glob("replay-sorted-*")} if Path(marts.shared_dir(spark)).exists() else set()
    marts.replayed(spark.createDataFrame(rows, "id long, day date").repartition(3), "day", "sorted", most=50)
    (path,) = set(Path(marts.shared_dir(spark)).glob("replay-sorted-*")) - paths
    files = sorted((path / "rows").rglob("*.parquet"))
    days = [[r.day for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) == 3 and all(d == sorted(d) for d in days) and len(sum(days, [])) == 300


def test_response_query_keeps_no_state_store(spark, tmp_path):
    import duckdb

    from tallyforge.plans import ALL

    begin, r = datetime(1997, 11, 20), random.Random(2)
    orders = [(i, i, "O", 1.0, begin + timedelta(days=r.randint(0, 90)), r.choice(["1-URGENT", "5-LOW"])) for i in range(200)]
    items = [(i, r.randint(1, 5), r.randint(0, 9), n, float(r.randint(1, 9)), 1.0, 0.0, 0.0, r.choice("RAN"), "O", begin) for i in range(200) for n in range(1, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    shared = Path(marts.shared_dir(spark))
    before = set(shared.glob("stream-responses-*"))
    df = ALL["stream_response_windows"].run(spark, str(tmp_path))
    got = sorted(map(str, map(tuple, df.collect())))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(df.columns)} FROM ({ALL['stream_response_windows'].sql})").fetchall())) and len(got) > 50
    (folder,) = set(shared.glob("stream-responses-*")) - before
    assert (folder / "checkpoint").exists() and not (folder / "checkpoint/state").exists()
