"""Shards of near equal bytes, whole groups where they fit, gapless slots, whatever fills a range."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import sharding
from tallyforge.llm.queries import QUERIES


def rows_of(seed=2):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    hot, twice = text(100), text(90)
    rows = [(i, text(r.randint(0, 300))) for i in range(1500)] + [(5000 + i, hot) for i in range(900)] + [(7, twice)] * 400 + [(None, None)] * 60 + [(9000 + i, "") for i in range(50)]
    rows += [(10_000 + i, t) for i in range(100) for t in [text(40)] for _ in range(4)] + [(None, "x" * 5000), (20_000, "y" * 60_000)]
    r.shuffle(rows)
    return rows


def size(t):
    return len((t or "").encode()) + 8


@pytest.mark.parametrize("bucket", [sharding.BUCKET, 10])
def test_laws(spark, tmp_path, monkeypatch, bucket):
    rows = rows_of()
    spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _unit string, shard string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    if bucket == sharding.BUCKET:
        got = QUERIES["op13_sharding"](spark, str(tmp_path)).collect()
    else:
        got = sharding.sharded(spark.read.parquet(f"{tmp_path}/documents.parquet"), bucket=bucket).select("*", F.lit("bytes").alias("law"), F.lit(None).alias("grown_shard")).collect()
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == want
    assert {(g.law, g.grown_shard) for g in got} == {("bytes", None)} and {g.shard for g in got} <= set(range(24))
    filled, slots, places = defaultdict(int), defaultdict(list), defaultdict(set)
    for g in got:
        filled[g.shard] += g.size
        slots[g.shard].append(g.slot)
        places[g.text_crc32, g.size].add(g.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    giant = max(filled, key=filled.get)
    rest = [b for s, b in filled.items() if s != giant]
    assert len(filled) == 24 and filled[giant] == 60_008 and max(rest) < 1.02 * min(rest)
    several = [p for k, p in places.items() if sum(c for (_, s, crc), c in want.items() if (crc, s) == k) == 4]
    assert len(several) > 90 and sum(len(p) > 1 for p in several) <= 5
    assert len(places[zlib.crc32(b""), 8]) < 5


def test_same_for_every_layout(spark):
    rows = spark.createDataFrame(list({i: (i, t) for i, t in rows_of() if i is not None}.values()), "doc_id long, text string")
    one, many = (sorted(map(tuple, sharding.sharded(rows.repartition(n), shards=5).collect())) for n in (1, 17))
    assert one == many


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((g.doc_id, g.slot) for g in sharding.sharded(few).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert sharding.sharded(few.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    rows = rows_of()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    sharding.write_shards(docs, f"{tmp_path}/out", shards=6)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.columns == ["doc_id", "text", "n", "shard"]
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    sizes = [r[1] for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).collect()]
    assert len(sizes) == 6 and max(sizes) - min(sizes) < 61_000
