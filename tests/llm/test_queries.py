"""Each query against brute force on odd rows, and on empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tallyforge.llm import licences, packing, pseudonyms, secrets, simhash
from tallyforge.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op6_packing", "op9_ann", "op12_spelling"}))
def test_one_row_for_each_document(spark, sf_dir, docs, name):
    got = sorted((r.doc_id is None, r.doc_id) for r in QUERIES[name](spark, sf_dir).select("doc_id").collect())
    assert got == sorted((r.doc_id is None, r.doc_id) for r in docs.collect())


def test_decontaminate(spark, sf_dir, docs):
    items = {r.item_id: WORD.findall(low(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op2_decontaminate"](spark, sf_dir).collect()}
    for r in docs.where("doc_id IS NOT NULL").collect():
        w, hit, its = WORD.findall(low(r.text)), set(), set()
        for i, x in items.items():
            n = min(10, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == x[s : s + n]:
                        hit |= set(range(a, a + n))
                        its.add(str(i))
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(w), len(hit), len(its), bool(hit))
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()


@pytest.mark.parametrize("hot", [4096, 1])
def test_simhash(spark, sf_dir, docs, hot):
    fps = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    least[a] = least[b] = min(least[a], least[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, sf_dir, hot).where("doc_id IS NOT NULL").collect()}
    assert got == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    rows = QUERIES["op6_packing"](spark, sf_dir).collect()
    texts = defaultdict(list)
    for r in docs.where("doc_id <> 10 OR doc_id IS NULL").collect():
        texts[r.doc_id].append(r.text or "")
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, (text,) in texts.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(whole[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_token_cache_is_exact():
    import random
    from array import array

    from tokenizers import Tokenizer

    whole, own, r = Tokenizer.from_file(packing.vocabulary()), packing.WordTokens(packing.vocabulary()), random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("abZÉß'.,;!?3٣ \n\t́İΣσς|<>Kſ") for _ in range(r.randint(0, 14)))
        assert own.ids(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_secrets(spark, sf_dir, docs):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: r for r in QUERIES["op10_secrets"](spark, sf_dir).collect()}
    for r in docs.collect():
        t = r.text or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in a.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_entropy_span_and_allow_list(spark):
    rows = spark.createDataFrame([(1, "key Zx8Qv2Lm9Rt4Wn7Ks3Hd6Jf1 end"), (2, "id 123e4567-e89b-12d3-a456-426614174000"), (3, "EXAMPLEexample0123456789abcdef")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start) for s in r.secret_spans] for r in secrets.find_secrets(rows).collect()}
    assert got == {1: [("entropy", 4)], 2: [], 3: []}


def test_pseudonyms_keep_format_and_links(spark):
    text = "call +1 (988) 555-2485 or 988-555-2485, card 4041894974608795 4041-8949-7460-8795 ip 42.144.35.254 ssn 123-45-6789 on 2024-02-29 bad 4041894974608796 2023-02-29"
    r = pseudonyms.pseudonymise(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "k").collect()
    out = r[0].text
    assert r[1].text is None and r[1].pii_kinds == []
    assert re.sub(r"\d", "9", out) == re.sub(r"\d", "9", text.replace("42.144.35.254", re.search(r"ip (\S+)", out)[1]))
    for value in ("555-2485", "4041894974608795", "42.144.35.254", "123-45-6789", "2024-02-29"):
        assert value not in out
    assert "4041894974608796" in out and "2023-02-29" in out
    cards = re.findall(r"card (\d{16}) (\S+)", out)[0]
    assert cards[0] == cards[1].replace("-", "")
    digits = [int(c) for c in cards[0]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


@pytest.mark.parametrize("ab", [(17, 43), (10, 10), (8, 13)])
def test_feistel_is_a_permutation(spark, ab):
    from pyspark.sql import functions as F

    a, b = (F.lit(x).cast("long") for x in ab)
    got = [r.y for r in spark.range(ab[0] * ab[1]).select(pseudonyms.feistel(F.col("id"), a, b, "k", "t").alias("y")).collect()]
    assert sorted(got) == list(range(ab[0] * ab[1])) and got != sorted(got)


def test_licences(spark):
    rows = [(1, "x.\nLicensed under the Apache License, Version 2.0."), (2, "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."), (3, None), (4, "no licence here"), (5, "# Licensed under the Apache License,\n# Version 2.0.")]
    got = {r.doc_id: r.licences for r in licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["GPL-3.0-only", "MIT"], 3: [], 4: [], 5: ["Apache-2.0"]}


def test_nearest(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 8 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    got = defaultdict(list)
    for r in QUERIES["op9_ann"](spark, sf_dir).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    queries = [i for i in ids if i % 100 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        want = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:10]
        assert [(v, pytest.approx(s)) for _, v, s in sorted(got[q])] == [(v, s) for s, v in want]


def test_near_vectors_far_from_zero():
    import pandas as pd

    from tallyforge.llm import ann

    r = np.random.default_rng(4)
    x = 1e6 + r.standard_normal((400, 8)) * 1e-2
    own, ask = (pd.DataFrame({k: range(len(x)), "v": list(x)}) for k in ("vid", "qid"))
    found = ann.nearest_in_block(own, ask.head(50)).groupby("qid")["vid"].apply(list)
    for q in range(50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert found[q] == np.lexsort((np.arange(len(x)), d))[: ann.KEEP].tolist()
