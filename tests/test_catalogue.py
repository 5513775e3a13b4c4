"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tallyforge.plans import ALL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(n for n, q in ALL.items() if q.sql))
def test_same_as_sql(spark, duck, name):
    df = ALL[name].run(spark, SF)
    found = duck.execute(ALL[name].sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted([plain(v) for v in r] for r in found.fetchall())
    got = sorted([plain(v) for v in r] for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert len(got) == len(want) and got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def many(spark, folder, copies=4):
    """Orders, lines and parts several times over with shifted keys, in another order of lines for each copy: SKUs of equal amounts, added up in different orders."""
    from pyspark.sql import functions as F

    each = spark.range(copies).withColumnRenamed("id", "_k")
    for name, keys in {"part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey"]}.items():
        rows = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(each)
        moved = rows.withColumns({k: F.col(k) + F.col("_k") * 1_000_000 for k in keys}).orderBy(F.xxhash64(*keys, "_k"))
        moved.drop("_k").write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for name in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["global_rank", "product_opportunity"])
def test_ties_and_halves_do_not_depend_on_the_order_of_additions(spark, tmp_path, name):
    con = many(spark, str(tmp_path))
    df = ALL[name].run(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ALL[name].sql}) ORDER BY sku_id").fetchall()
    assert [tuple(r) for r in df.orderBy("sku_id").collect()] == want
    if name == "global_rank":
        ranks = {r.sku_id: r["rank"] for r in df.collect()}
        assert all(ranks[s] < ranks[s + 1_000_000] for s in ranks if s + 1_000_000 in ranks)


@pytest.mark.parametrize("name", ["daily_sku_sales", "aov_tags"])
def test_partitions_follow_the_rows(spark, duck, monkeypatch, name):
    """Order lines are dealt over as many partitions as their number asks for, with the same result."""
    from tallyforge.sources import staging

    monkeypatch.setattr(staging, "TASK_ROWS", 300)
    test_same_as_sql(spark, duck, name)
    plan = ALL[name].run(spark, SF)._jdf.queryExecution().toString()
    parts = -(-duck.execute("SELECT count(*) FROM lineitem").fetchone()[0] // 300)
    assert f", {parts}), REPARTITION_BY_NUM" in plan
