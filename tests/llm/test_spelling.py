"""Variants against all pairs of words, at every size of a node."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import spelling
from tallyforge.llm.queries import QUERIES


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 6
    return {w: c for w, c in n.items() if c >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    base = ["".join(r.choice("aeiountrslé") for _ in range(r.randint(6, 9))) for _ in range(60)] + ["aeaeae", "eaeaea", "Àbcdefg", "àbcdefg", "hvwkjq", "hvwkjx", "hvwkj÷q", "abcdef" * 40]
    words = []
    for w in base:
        k = r.choice([1, 5, 30, 200])
        words += [w] * k
        for _ in range(4):
            i, x = r.randrange(len(w)), r.choice("aetzé")
            words += [r.choice([w[:i] + w[i + 1 :], w[:i] + x + w[i:], w[:i] + x + w[i + 1 :]])] * r.choice([1, 5, 6, 30])
    words += ["chainee"] * 5 + ["chaineea"] * 40 + ["chaineeat"] * 250
    r.shuffle(words)
    words = [w.upper() if w.isascii() and r.random() < 0.1 else w for w in words]
    rows = [(i, r.choice([" ", ", ", "\n", "1"]).join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    return [*rows, (None, " ".join(words[:300])), (3, rows[3][1]), (900, None), (901, ""), (902, " ".join(words) * 3)]


@pytest.mark.parametrize("node", [spelling.NODE, 20, 1])
def test_against_all_pairs(spark, tmp_path, monkeypatch, node):
    monkeypatch.setattr(spelling, "SLICE", 1000)
    rows = corpus()
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    if node == spelling.NODE:
        found = QUERIES["op12_spelling"](spark, str(tmp_path))
    else:
        found = spelling.variants(spelling.vocabulary(spark.read.parquet(f"{tmp_path}/documents.parquet")), node=node)
    got = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(words_of(rows))
    assert len(got) == len(want) and set(got) == want
    assert any(g[1] and g[2] != g[1] for g in got)


def test_hash_drops_a_letter(spark):
    rows = [(i, "wordlike " * 5) for i in range(2000)]
    got = {r.word: r.n for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == words_of(rows) and len(got) > 1


def test_flood_of_one_vector(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("hvwkjqxyz") for _ in range(7)) for _ in range(1500)})
    n = {w: 5 + i % 40 for i, w in enumerate(words)}
    got = spelling.variants(spark.createDataFrame([*n.items()], "word string, n long"), node=50).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == brute(n)
