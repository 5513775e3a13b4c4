"""Secret spans against a plain one-pass version, on odd, long and crowded texts."""

import math
import random
import re
import time

import pytest

from tallyforge.llm import secrets
from tallyforge.llm.queries import QUERIES

WORDS = re.compile(r"(?:[A-Za-z][a-z]*[0-9]{0,4}[_/+-])+[A-Za-z][a-z]*[0-9]{0,4}")


def entropy(text, width):
    windows = [text[i : i + width] for i in range(max(1, len(text) - width + 1))] if text else []
    return max((-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) for w in windows), default=0.0)


def base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def brute(text):
    sure, fresh = base(text), []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text):
        t = m[0]
        if any(s < m.end() and m.start() < e for s, _, e, _ in sure) or any(re.search(p, t) for p in secrets.ALLOWED) or WORDS.fullmatch(t):
            continue
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t):
            dense = entropy(t, 20) >= 3.0
        else:
            dense = bool(re.search("[0-9]", t) and re.search("[A-Za-z]", t)) and entropy(t, 20) >= 3.6
        fresh += [(m.start(), 3, m.end(), "entropy")] if dense else []
    return sorted(sure + fresh)


def odd_texts(n):
    r, out = random.Random(8), []
    some = [lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(15, 60))), lambda: "".join(r.choice("ABCDEFabcxyzXYZ0189+/_-") for _ in range(r.randint(10, 70))) + "=" * r.randint(0, 3), lambda: "AKIA" + "Q7" * r.randint(5, 12), lambda: r.choice(["Password", "api_key", "token"]) + r.choice([": ", "=", "' = \""]) + "s3cr.et/" + "a1" * r.randint(0, 20), lambda: r.choice(["é", "\U0001f600 ", "some_Path1234/to-File", "word ", "a" * 30 + "1", "123e4567-e89b-12d3-a456-426614174000", "\n", '"', "xX_" * 9])]
    for _ in range(n):
        out.append(r.choice(["", " "]).join(r.choice(some)() + r.choice(["", " ", ","]) for _ in range(r.randint(0, 12))))
    return [*out, "", None]


def test_all_spans_against_brute_force(spark):
    texts = odd_texts(400)
    rows = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, _base string")
    got = secrets.find_secrets(rows).collect()
    found = 0
    for g in got:
        want = [(kind, s, e) for s, _, e, kind in brute(texts[g.doc_id] or "")]
        assert [(x.kind, x.start, x.end) for x in g.secret_spans] == want and g._base == "keep"
        found += sum(k == "entropy" for k, _, _ in want)
    assert found > 100


def test_query_columns(spark, tmp_path):
    import hashlib

    texts = odd_texts(60)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for g in QUERIES["op10_secrets"](spark, str(tmp_path)).collect():
        sure, whole = base(texts[g.doc_id] or ""), brute(texts[g.doc_id] or "")
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x[1] == k for x in sure) for k in range(3))
        assert g.base_sha256 == hashlib.sha256(join(sure).encode()).hexdigest() and g.spans == join(whole) and g.n_entropy == len(whole) - len(sure)


def test_window_entropy(spark):
    from pyspark.sql import functions as F

    texts = ["aaaa", "abcd", "aabbccddeeff", "", "x" * 30 + "qwertzuiop"]
    characters = "abcdefghijklmnopqrstuvwxyz"
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", secrets.window_entropy(F.col("t"), characters, 6).alias("h")).collect()}
    for t in texts:
        assert got[t] == pytest.approx(entropy(t, 6), abs=1e-9)


@pytest.mark.parametrize("kind", ["candidate", "hex spans", "both"])
def test_long_texts_take_linear_time(spark, kind):
    r = random.Random(3)
    one = lambda a, n: "".join(r.choice(a) for _ in range(n))
    text = {"candidate": lambda: one("ABCDEFGHxyz0189+/", 1_000_000), "hex spans": lambda: " ".join(one("0123456789abcdef", 30) for _ in range(20_000)), "both": lambda: " ".join(one("0123456789abcdef", 30) + " " + one("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 40) for _ in range(5000))}[kind]()
    began = time.perf_counter()
    got = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("size(secret_spans) AS n", "secret_spans[size(secret_spans) - 1].end AS e").first()
    assert got.e == len(text) and got.n == {"candidate": 1, "hex spans": 20_000}.get(kind, got.n) and (kind != "both" or 9900 < got.n <= 10_000)
    assert time.perf_counter() - began < 60
