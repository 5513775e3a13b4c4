"""Cuts against a plain list of tokens, over block borders, and rebuilt texts."""

import hashlib
import random
import re

import pytest

from tallyforge.llm import fim
from tallyforge.llm.queries import QUERIES

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    u, d = TOKEN.findall(text), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return text, "plain", len(u), None, None
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(u), len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(u), len(p), len(m)


def odd(n, seed=4):
    r = random.Random(seed)
    some = ["abc", "Z", " ", "\n", "é", "\U0001f600", "x" * 40, "<", "<P", "M>", ">", "[", "`", "{", "@", "Ł", "12", ""]
    return ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", None, "a" * 9000, "has <S> inside", " " * 5000, "ab" * 3000 + "é" + "c" * 9000]


@pytest.mark.parametrize("size", [1, 3, 7, fim.BLOCK])
def test_every_place(size):
    for text in odd(60):
        tokens = TOKEN.findall(text or "")
        units, at = fim.Units(text or "", size), 0
        assert units.n == len(tokens)
        for u in range(len(tokens) + 1) if len(tokens) < 200 else (0, 1, len(tokens) // 2, len(tokens)):
            at = sum(map(len, tokens[:u]))
            assert units.place(u) == at


def test_query(spark, tmp_path):
    rows = list(enumerate(odd(400))) + [(None, "no id here, only words"), (3, odd(400)[3]), (7, "x " * 300_000)]
    spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, fim string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((str(i), n, form, str(p), str(m), sha(out), sha(t or "")) for i, t in rows for out, form, n, p, m in [plain(i, t)])
    got = sorted((str(g.doc_id), g.n, g.form, str(g.prefix_chars), str(g.middle_chars), g.output_sha256, g.restored_sha256) for g in QUERIES["op11_fim"](spark, str(tmp_path)).collect())
    assert got == want and {"plain", "psm", "spm"} == {g[2] for g in got}


def test_other_columns_stay(spark):
    got = fim.transform(spark.createDataFrame([(1, "some words", 5)], "doc_id long, text string, n long"), transformed=100, suffix_first=100).first()
    assert got.n == 5 and got.fim.form == "spm" and got.fim.n == 3 and got.fim.text.startswith("<S>")
