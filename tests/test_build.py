"""A folder of exports to tables: copies, spellings, extra and unknown files, conflicts, refund states."""

from tallyforge.operators import structure
from tallyforge.sources import harmonise as H
from tallyforge.sources.build import build_tables
from tallyforge.sources.files import inventory


def test_folder_to_tables(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a.csv").write_text('sku_id,sku_name,unit price,list-price,inventory_optional,note\ns1,"One, two",10,11,5,x\ns2,Two,,"1,200",0,y\n')
    (src / "a.csv").write_text((src / "a.csv").read_text().replace("unit price", "unit_price"))
    (src / "sub" / "copy.csv").write_text((src / "a.csv").read_text())
    (src / "b.csv").write_text("SKU_ID,sku name,price,inventory_optional\ns2,Two,1500,3\ns3,Three,7,1\n")
    (src / "orders.csv").write_text("order_id,sku_id,payment_time,qty,pay_amount\no1,s1,2024-01-02 03:04:05,2,19.5\no1,s1,2024-01-02 03:04:05,2,19.5\n")
    (src / "odd.csv").write_text("what,ever\n1,2\n")
    (src / "readme.txt").write_text("no table")
    (src / ".hidden.csv").write_text("sku_id,price\nx,1\n")
    manifest = {r.file.rsplit("/", 1)[1]: r for r in build_tables(spark, str(src), str(out)).collect()}
    assert {k: r.status for k, r in manifest.items()} == {"a.csv": "classified", "copy.csv": "copy", "b.csv": "classified", "orders.csv": "classified", "odd.csv": "needs_data", "readme.txt": "needs_data"}
    assert (manifest["a.csv"].rows, manifest["a.csv"].merged_rows, manifest["a.csv"].copies) == (2, 3, 2)
    skus = {r.sku_id: r for r in spark.read.parquet(f"{out}/skus").collect()}
    assert (skus["s1"].price == 11.0 and skus["s1"].unit_price == "10", skus["s1"].sku_name, skus["s2"].price, skus["s2"].note) == (True, "One, two", 1200.0, "y")
    bad = spark.read.parquet(f"{out}/skus_conflicts").collect()
    assert {(r.sku_id, r.column) for r in bad} == {("s2", "price"), ("s2", "inventory_optional")}
    orders = spark.read.parquet(f"{out}/orders").collect()
    assert len(orders) == 2 and orders[0].quantity == 2 and orders[0].paid_amount == 19.5 and orders[0].paid_time.hour == 3


def test_refund_states(spark):
    from pyspark.sql import functions as F

    states = [*H.REFUNDED, " Refunded ", "PARTIAL_REFUND", None, "paid", "", "closed"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(states)], "i int, s string").orderBy("i").select(H.counts_as_sale(F.col("s"))).collect()]
    assert got == [False] * 13 + [True] * 4


def test_gaps_on_both_sides_of_an_opportunity(spark):
    catalog = spark.createDataFrame([(1, 5), (2, 5)], "sku_id int, inventory int")
    sold = spark.createDataFrame([(2, 4.0, 8.0, 2), (3, 1.0, 1.0, 1)], "sku_id int, units double, gmv double, active_days int")
    got = {r.sku_id: r.opportunity_type for r in structure.opportunities(catalog, sold, "sku_id").collect()}
    assert got == {1: "needs_sales", 2: "low_inventory", 3: "response_present"}


def test_line_breaks_equal_rows_and_bad_ones(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "comments.csv").write_text('note_id,comment_time,comment_text\nn1,2024-01-02,"two\nlines, ""here"""\nn1,2024-01-02,plain\nn1,2024-01-02,plain\nn2,2024-01-03,a,b\n')
    head = "order_id,sku_id,paid_time,quantity,paid_amount\n"
    (src / "orders.csv").write_text(head + "o1,s1,2024-01-02,1.5,10\no2,s1,2024-01-02,two,10\no3,,2024-01-02,1,10\no4,s1,2024-01-02,2,-1\no5,s1,2024-01-02,2,\"1,200\"\n")
    manifest = {r.file.rsplit("/", 1)[1]: r for r in build_tables(spark, [str(src / "comments.csv"), str(src / "orders.csv")], str(out)).collect()}
    assert [(r.rows, r.broken, r.invalid, r.merged_rows) for r in (manifest["comments.csv"], manifest["orders.csv"])] == [(4, 1, 0, 3), (5, 0, 4, 1)]
    texts = sorted(r.comment_text for r in spark.read.parquet(f"{out}/comments").collect())
    assert texts == ["plain", "plain", 'two\nlines, "here"']
    assert [r.record for r in spark.read.parquet(f"{out}/comments_broken").collect()] == ["n2,2024-01-03,a,b"]
    bad = {r.order_id: r.invalid_reason.split(":")[0] for r in spark.read.parquet(f"{out}/orders_invalid").collect()}
    assert bad == {"o1": "quantity", "o2": "quantity", "o3": "sku_id", "o4": "paid_amount"}
    good = spark.read.parquet(f"{out}/orders").first()
    assert (good.order_id, good.quantity, good.paid_amount) == ("o5", 2, 1200.0)


def test_times_of_order_lines(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    times = {"a": "2024/1/2 03:04", "b": "45293.5", "c": "2024-01-02T03:04:05.25", "d": "20240102", "e": "", "f": "soon", "g": "19999.5", "h": "2024-02-30"}
    (src / "orders.csv").write_text("order_id,sku_id,paid_time,quantity,paid_amount\n" + "".join(f"{k},s1,{v},1,1\n" for k, v in times.items()))
    build_tables(spark, str(src), str(out))
    got = {r.order_id: r.t for r in spark.read.parquet(f"{out}/orders").selectExpr("order_id", "date_format(paid_time, 'yyyy-MM-dd HH:mm:ss.SS') AS t").collect()}
    assert got == {"a": "2024-01-02 03:04:00.00", "b": "2024-01-02 12:00:00.00", "c": "2024-01-02 03:04:05.25", "d": "2024-01-02 00:00:00.00", "e": None}
    bad = {r.order_id: r.invalid_reason for r in spark.read.parquet(f"{out}/orders_invalid").collect()}
    assert bad == dict.fromkeys("fgh", "paid_time: not a date and time")


def test_moments_and_quantities(spark):
    from pyspark.sql import functions as F

    from tallyforge.functions import cleaning as C

    rows = spark.createDataFrame([(x,) for x in ("20000", "60000", "60000.5", "60001", "2024-13-01", "2024", "24:00", "2024-01-02 25:00", "1,200", "2.0", "2.5", " ", None, "1e3")], "x string")
    got = {r.x: (r.t, r.q, r.m) for r in rows.select("x", F.date_format(C.parse_timestamp(F.col("x")), "yyyy-MM-dd HH:mm").alias("t"), C.parse_quantity(F.col("x")).alias("q"), C.is_missing(F.col("x")).alias("m")).collect()}
    assert [x for x, v in got.items() if v[0]] == ["20000", "60000"] and got["20000"][0] == "1954-10-03 00:00"
    assert (got["1,200"][1], got["2.0"][1], got["2.5"][1], got["1e3"][1]) == (1200, 2, None, 1000)
    assert [x for x, v in got.items() if v[2]] == [" ", None]


def test_part_of_a_grain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("channel,note_type,gmv,paid_orders,product_clicks\nx,v,1,,2\nx,v,,3,2\n")
    build_tables(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [(r.channel, r.gmv, r.paid_orders) for r in spark.read.parquet(f"{tmp_path}/out/traffic_source").collect()] == [("x", 1.0, 3.0)]


def test_digests_by_blocks(spark, tmp_path):
    """Of many blocks, the same alone or among others; a line that moves, ends or is missing changes them."""
    lines = [f"row {i},{i * i}" for i in range(3000)]
    text = "\n".join(lines)
    files = {"a": text, "b": text, "c": text + "\n", "d": "\n".join([lines[1], lines[0], *lines[2:]]), "e": text.replace("row 7,49", "row 8,49", 1), "f": "\r\n".join(lines), "g": "", "h": "\n"}
    for name, t in files.items():
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"{name}.csv").write_bytes(t.encode())
    got = {r.file[-5]: r for r in inventory(spark, str(tmp_path / "all"), block=4096).collect()}
    assert set(got) == set("abcdefh") and len({r.digest for r in got.values()}) == 6 and (got["a"].digest, got["a"].copies) == (got["b"].digest, 2)
    assert (got["a"].lines, got["a"].header, got["h"].lines, got["f"].header) == (3000, "row 0,0", 1, "row 0,0")
    alone = inventory(spark, [str(tmp_path / "all" / "a.csv")], block=4096).first()
    assert alone.digest == got["a"].digest and alone.copies == 1


def test_conflicts_broadcast_no_table(spark):
    rows = H.tagged([spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sku_id string, price double"), spark.createDataFrame([("a", 2.0), ("b", 2.0)], "sku_id string, price double")])
    found = H.merge_conflicts(rows, ["sku_id"])
    assert [(r.sku_id, r.value_a, r.value_b) for r in found.collect()] == [("a", "1.0", "2.0")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_order_cells_are_parsed_a_few_times(spark):
    """A row's reason parses each cell without regular expressions, however often its number is looked at."""
    raw = spark.createDataFrame([("1", "s", "1,200", "¥3"), ("2", "s", "1.5", "3"), ("3", "s", "2", "—"), ("4", "s", "nan", "1"), ("5", "s", "-1", "1"), (" ", "s", "1", "1")], "order_id string, sku_id string, quantity string, paid_amount string")
    marked = H.mark_orders(raw)
    assert [(r.invalid_reason or "good").split(":")[0] for r in marked.orderBy("paid_amount", "order_id").collect()].count("good") == 1
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("translate(") <= 8
    good, bad = H.validate_orders(raw)
    assert [(r.order_id, r.quantity, r.paid_amount) for r in good.collect()] == [("1", 1200, 3.0)] and bad.count() == 5
