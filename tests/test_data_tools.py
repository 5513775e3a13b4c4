"""Profiles, periods, matching, rules and published runs against plain versions."""

import itertools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import intervals, profiles, rules
from tallyforge.sources import matching, publish


def test_sketches_merge(spark):
    """Merged parts say what the whole says: exact parts alike, sketches within their bounds."""
    r = random.Random(1)
    rows = [(i % 7, r.choice([None, r.gauss(50, 20), float("nan")]), f"k{min(r.randint(1, 3000), r.randint(1, 3000))}" if i % 3 else "often", None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day int, x double, s string, nothing int").withColumn("list", F.array("x"))
    parts = profiles.sketches(df, ["day"])
    assert parts.count() == 7 * 3
    merged, whole = ({x.column: x for x in profiles.described(p).collect()} for p in (profiles.merge(parts), profiles.sketches(df, columns=["x", "s", "nothing"])))
    values = sorted(x for _, x, _, _ in rows if x is not None and x == x)
    for got in (merged, whole):
        assert (got["x"].rows, got["x"].nulls) == (20_000, sum(x is None for _, x, _, _ in rows))
        assert float(got["x"].least) == values[0] and float(got["x"].most) == values[-1] and got["x"].mean == pytest.approx(sum(values) / len(values))
        for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert abs(sum(v <= got["x"][p] for v in values) / len(values) - q) < 0.03
        assert got["s"].distinct == pytest.approx(len({s for _, _, s, _ in rows}), rel=0.03) and got["s"].p50 is None
        assert got["s"].top[0][0] == "often" and got["s"].top[0][1] == pytest.approx(sum(s == "often" for _, _, s, _ in rows), rel=0.01)
        assert (got["nothing"].nulls, got["nothing"].null_share, got["nothing"].distinct, got["nothing"].mean, got["nothing"].least) == (20_000, 1.0, 0, None, None)
    assert profiles.described(profiles.sketches(df.limit(0), columns=["x"])).count() == 1  # a table without rows has one, of nothing


def test_periods(spark):
    r, begin = random.Random(2), date(2024, 1, 1)
    rows = [(s, begin + timedelta(days=a), begin + timedelta(days=a + r.randint(-1, 4))) for s in "abc" for a in r.sample(range(80), 12)] + [("a", None, begin), ("b", begin, None)]
    df = spark.createDataFrame(rows, "source string, first_day date, last_day date")
    days = {s: {a + timedelta(days=i) for x, a, b in rows if x == s and a and b for i in range((b - a).days + 1)} for s in "abc"}
    one = lambda x: {x.first_day + timedelta(days=i) for i in range(x.days)}
    found = intervals.covered(df, ["source"]).collect()
    assert {s: set().union(*(one(x) for x in found if x.source == s)) for s in "abc"} == days
    assert all((x.first_day - timedelta(days=1)) not in days[x.source] and (x.last_day + timedelta(days=1)) not in days[x.source] for x in found)
    gaps = {s: set().union(*(one(x) for x in intervals.missing(df, ["source"]).collect() if x.source == s)) for s in "abc"}
    assert gaps == {s: {min(d) + timedelta(days=i) for i in range((max(d) - min(d)).days)} - d for s, d in days.items()}
    got = {}
    for x in intervals.shared(df, "source", {"c": 1, "a": 2, "b": 3}).collect():
        got |= {day: (x.sources, x.primary) for day in one(x)}
    rank = {"c": 1, "a": 2, "b": 3}
    have = {d: sorted(s for s in "abc" if d in days[s]) for d in set().union(*days.values())}
    assert got == {d: (",".join(s), min(s, key=rank.get)) for d, s in have.items()}


def greedy(pairs):
    """Pairs by falling score, each side once."""
    out, headers, names = set(), set(), set()
    for score, column, canonical in sorted(pairs, key=lambda p: (-p[0], p[2], p[1])):
        if column not in headers and canonical not in names:
            headers.add(column)
            names.add(canonical)
            out.add((column, canonical))
    return out


def test_rounds_of_mutual_best(spark):
    r, rows = random.Random(3), []
    for f in range(12):
        pairs = r.sample(list(itertools.product("abcdef", "uvwxy")), 14)
        rows += [(f"f{f}", "t", h, c, float(score)) for (h, c), score in zip(pairs, r.sample(range(100), 14), strict=True)]
    df = spark.createDataFrame(rows, "file string, table_name string, column string, canonical string, score double")
    got = matching.assigned(df).collect()
    for f in {x[0] for x in rows}:
        assert {(x.column, x.canonical) for x in got if x.file == f} == greedy([(s, h, c) for g, _, h, c, s in rows if g == f])
    assert max(x["round"] for x in got) > 1 and matching.assigned(df.limit(0)).count() == 0


def test_audit(spark):
    names = ["SKU id", "sku_nme", "price", "unit_price", "inventory_optionel", "what", ""]
    headers = spark.createDataFrame([("f", "skus", n) for n in names] + [("g", "skus", "cost")], "file string, table_name string, column string")
    extra = spark.createDataFrame([("skus", "cost", "cost_optional")], "table_name string, header string, canonical string")
    got = {(x.file, x.column): (x.canonical, x.outcome, x.instead_of) for x in matching.audit(headers, spark, extra).collect()}
    assert got == {
        ("f", "SKU id"): ("sku_id", "chosen", None), ("f", "sku_nme"): ("sku_name", "review", None), ("f", "price"): ("price", "chosen", None),
        ("f", "unit_price"): (None, "conflicting", "price"), ("f", "inventory_optionel"): ("inventory_optional", "review", None), ("f", "what"): (None, "unmatched", None),
        ("f", ""): (None, "unmatched", None), ("g", "cost"): ("cost_optional", "chosen", None),
    }


def test_rules(spark):
    facts = [("s1", "t", "gmv", 5.0, "money", "sum"), ("s1", "u", "gmv", 5.0 + 1e-12, "money", "sum"), ("s2", "t", "gmv", 5.0, "count", "sum"), ("s2", "u", "gmv", 6.0, None, "sum"),
             ("s1", "t", "share", 0.4, "percent", "direct"), ("s1", "t", "share", 0.6, "percent", "direct"), ("s2", "t", "share", 0.7, "percent", "direct"), ("s3", "t", "share", None, "percent", None)]
    df = spark.createDataFrame(facts, "shop string, task_id string, metric_key string, value double, unit string, aggregation string")
    R = rules.Rule
    checks = [R("a", "unique", "gmv"), R("b", "unit", "gmv", ("money",)), R("c", "owner", "gmv", ("t",)), R("d", "caliber", "share", ("ratio",)), R("e", "must_sum_to", "share", (1.0, 1e-9)),
              R("f", "bounds", "share", (0.0, 0.5)), R("g", "known", "share"), R("h", "unique", "absent")]
    got = {x.rule: (x.checked, x.failed, x.holds) for x in rules.check(df, checks, ["shop"]).collect()}
    assert got == {"a": (2, 1, False), "b": (4, 2, False), "c": (4, 2, False), "d": (4, 1, False), "e": (3, 2, False), "f": (4, 2, False), "g": (4, 1, False), "h": (0, 0, True)}
    assert {x.checked for x in rules.check(df.limit(0), checks, ["shop"]).collect()} == {0}
    for bad in (("x", "odd", "gmv"), ("x", "caliber", "gmv", ("odd",))):
        with pytest.raises(ValueError):
            R(*bad)


def test_published_together(spark, tmp_path):
    folder, df = str(tmp_path), spark.createDataFrame([(1, "a")], "n int, s string")
    with pytest.raises(LookupError):
        publish.published(spark, folder, "x")
    publish.publish(spark, {"x": df, "y": df}, folder, "one")
    broken = df.withColumn("n", F.raise_error(F.lit("stopped half-way")).cast("int"))
    with pytest.raises(Exception, match="stopped half-way"):
        publish.publish(spark, {"x": df.withColumn("n", F.lit(2)), "y": broken}, folder, "two")
    seen = lambda t: [tuple(r) for r in publish.published(spark, folder, t).collect()]
    assert (seen("x"), seen("y"), publish.current(spark, folder)["run"]) == ([(1, "a")], [(1, "a")], "one")
    publish.publish(spark, {"x": df.withColumn("n", F.lit(3))}, folder, "two")
    assert seen("x") == [(3, "a")] and [r.n for r in spark.read.json(f"{folder}/runs/two/x.json").collect()] == [3]
    publish.publish(spark, {"x": df}, folder, "two")
    assert seen("x") == [(3, "a")]
    with pytest.raises(LookupError):
        publish.published(spark, folder, "y")


def test_a_published_table_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(5).selectExpr("id", "IF(id > 2, NULL, CAST(id AS STRING)) AS s").mapInPandas(count, "id long, s string")
    publish.publish(spark, {"x": df}, str(tmp_path), "one")
    assert seen.value == 5
    for kind in publish.FORMATS:
        assert {tuple(r) for r in spark.read.schema("id long, s string").format(kind).load(f"{tmp_path}/runs/one/x.{kind}").collect()} == {(i, None if i > 2 else str(i)) for i in range(5)}
