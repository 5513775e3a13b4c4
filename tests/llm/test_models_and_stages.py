"""Classifiers on held-out rows, line dedup and near-duplicate groups against brute force, and the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import ann, langid, simhash, toxicity
from tallyforge.llm.components import components
from tests.llm.conftest import SCHEMA, prose


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7), (None, 3)]
    least = {x: x for ab in links if None not in ab and ab[0] != ab[1] for x in ab}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in least and b in least and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == least


def test_near_groups(spark):
    base = prose(1, 200).split()
    near = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(10, 190, 20)]
    rows = [(i, t) for i, t in enumerate([" ".join(base), *near, prose(50, 200), prose(51, 200), None, ""])] + [(100, " ".join(base).upper())]
    got = {r.doc_id: r.group_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(len(near) + 1)) and got[100] == 0
    assert got[len(near) + 1] == len(near) + 1 and got[len(near) + 2] == len(near) + 2 and got[len(near) + 4] == len(near) + 3


def test_toxicity_on_held_out(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = prose(i, 60).split()
        if toxic:
            w[r.randint(0, 59)] = r.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "a", 0))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs.where("doc_id % 3 <> 0"), marks.where("doc_id % 3 <> 0"))
    scored = toxicity.score(docs.where("doc_id % 3 = 0"), net).join(marks, "doc_id").collect()
    assert sum((x.toxicity >= toxicity.CUT) == bool(x.toxic) for x in scored) >= 0.95 * len(scored)


def test_toxicity_without_labels(spark, docs):
    net = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.score(docs, net).collect()} == {0.0}


def test_language_spans(spark):
    words = {"en": "the house and river with that thing", "de": "der schacht und nicht pflicht schule", "ru": "привет мир который это было"}
    rows = [(i, prose(i, 40, words[g]), g, "a", 0) for i, g in enumerate(["en", "de", "ru"] * 30)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    text = f"{prose(900, 30, words['en'])}. {prose(901, 30, words['de'])}. {prose(902, 30, words['ru'])}"
    (name, score, spans), (none, zero, _) = langid.identify([text, "12 34"], model)
    assert [s["lang"] for s in spans] == ["en", "de", "ru"] and name in words and 0 < score <= 1
    assert (none, zero) == ("und", 0.0)


def test_forest_recall(spark):
    import numpy as np

    r = np.random.default_rng(1)
    centres = r.standard_normal((40, 16))
    x = (centres[r.integers(0, 40, 3000)] + 0.3 * r.standard_normal((3000, 16))).astype(np.float32)
    old = ann.LEAF
    ann.LEAF = 128
    try:
        table = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        found = ann.search(table, F.col("vec_id") % 100 == 0).collect()
    finally:
        ann.LEAF = old
    hit = 0
    for q in range(0, 3000, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {f.vec_id for f in found if f.query_id == q})
    assert hit >= 0.9 * 300


def test_repeated_ids(spark):
    """One list for a query, one place for a candidate, by the least vector of each."""
    rows = [(0, [9.0, 1.0]), (0, [1.0, 5.0]), (0, [1.0, 5.0]), (7, [1.0, 6.0]), (7, [3.0, 5.0]), (8, [1.0, 4.5]), (9, [0.0, 0.0]), (9, [2.0, 5.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert [(f.query_id, f.rank, f.vec_id, f.score) for f in sorted(found)] == [(0, 1, 8, 0.5), (0, 2, 7, 1.0), (0, 3, 9, 1.0)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stage(spark, docs, sf_dir)
    kept = out.collect()
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in kept]
    assert None in ids and 12 in ids or name == "decontamination"
    if name == "simhash_near_dedup":
        assert 3 not in ids and 11 not in ids and {1, 2, 7} <= set(ids)
    if name == "decontamination":
        assert 8 not in ids and 12 not in ids and {1, 2, 3, 4, 5} <= set(ids)


def test_stages_take_empty_tables(spark, empty_dir):
    docs = spark.read.parquet(f"{empty_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty_dir).count() == 0


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_long_texts_score_as_one_piece(monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    net, docs = toxicity.Net.fresh(), [r.integers(0, 1 << 30, n).astype(np.int32) for n in (0, 1, 3, 4, 5, 6, 8, 9, 31, 400)]
    whole = net.raw(docs)
    for block in (1, 2, 4, 7):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        assert np.allclose(net.raw(docs), whole, atol=1e-5)


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not __import__("os").path.isdir(TABLES), reason="needs the given tables")
def test_queries_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    found = langid.op4_langid(spark, TABLES).join(docs, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right[0] > 250 and right[1] >= 0.97 * right[0]
    marks = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "toxic")
    x = toxicity.op8_toxicity(spark, TABLES).join(marks, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in x)
    assert hits >= 0.5 * sum(r.toxic for r in x) and hits >= 0.5 * sum(r.predicted for r in x)


def test_scores_do_not_depend_on_neighbours():
    import numpy as np

    r = np.random.default_rng(3)
    net, docs = toxicity.Net.fresh(), [r.integers(0, 1 << 30, n).astype(np.int32) for n in (0, 1, 2, 3, 0, 7, 40)]
    assert np.allclose(net.raw(docs), [net.raw([d])[0] for d in docs], atol=1e-5)
