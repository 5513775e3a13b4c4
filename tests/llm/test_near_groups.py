"""Near-duplicate groups against brute force over all pairs."""

import random

import numpy as np

from tallyforge.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """{id: least id of its group}, by all pairs with a Jaccard similarity of 0.8 or more."""
    root, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]) or sets[i] == sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in root}


def groups(spark, rows, **kw):
    return {r.doc_id: r.group_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}


def fresh(r, n):
    return [f"w{r.randint(0, 10**9)}" for _ in range(n)]


def pairs_near_the_limit(n, seed):
    """n pairs of 100 to 200 words with one run replaced, so that the similarity lies between 0.76 and 0.88."""
    r, rows = random.Random(seed), []
    for i in range(n):
        w = fresh(r, r.randint(100, 200))
        cut = round(len(w) * r.uniform(0.03, 0.1))
        at = r.randint(0, len(w) - cut)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:at] + fresh(r, cut) + w[at + cut :]))]
    return rows


def test_every_pair_at_the_limit(spark):
    rows = pairs_near_the_limit(700, 1)
    want = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a), shingles(b)
        want[i], want[j] = i, i if len(x & y) * 5 >= 4 * len(x | y) else j
    assert 100 < sum(k != v for k, v in want.items()) < 600
    assert groups(spark, rows) == want


def test_pairs_inside_a_family_on_one_template(spark):
    r = random.Random(2)
    template, rows = fresh(r, 99), []
    for i in range(0, 600, 2):
        w = template + fresh(r, 13)
        x = list(w)
        for at in (r.randint(5, 40), r.randint(50, 90)) if i % 10 else ():
            x[at] = fresh(r, 1)[0]
        rows += [(i, " ".join(w)), (i + 1, " ".join(x if i % 10 else fresh(r, 112)))]
    want = brute(rows)
    assert sum(k != v for k, v in want.items()) == 240
    assert groups(spark, rows) == want
    assert groups(spark, rows, block=7) == want


def test_a_large_family_of_near_copies(spark):
    r = random.Random(3)
    base, rows = fresh(r, 150), []
    for i in range(200):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            w[r.randint(0, 149)] = fresh(r, 1)[0]
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert groups(spark, rows) == want and groups(spark, rows, block=9) == want


def test_pairs_of_long_texts_at_the_limit(spark):
    r, rows = random.Random(5), []
    shared = fresh(r, 40)
    for i in range(0, 120, 2):
        w = shared + fresh(r, r.choice((460, 900, 1020, 2040, 3000)))
        cut = round(len(w) * r.uniform(0.05, 0.15))
        rows += [(i, " ".join(w)), (i + 1, " ".join(w[:-cut] + fresh(r, r.randint(0, cut))))]
    want = brute(rows)
    assert 5 < sum(k != v for k, v in want.items()) < 55
    assert groups(spark, rows) == want


def test_wide_sketches_bound_the_difference():
    r = np.random.default_rng(6)
    for n in (400, 513, 1000, 1024, 1025, 5000):
        a = r.integers(0, 2**64, n, np.uint64)
        for out in (0.05, 0.11, 0.25, 1.0):
            b = np.concatenate([a[: round(n * (1 - out))], r.integers(0, 2**64, round(n * out / 2), np.uint64)])
            same = len(np.intersect1d(a, b))
            similar = same * 5 >= 4 * (len(a) + len(b) - same)
            may = simhash.may_be_similar(simhash.wide_sketch(a), len(a), simhash.wide_sketch(b), len(b), 0.8)
            assert may or not similar
            assert not may or out < 1 or min(len(a), len(b)) <= 512


def test_repeats_count_once(spark):
    r = random.Random(4)
    phrase = fresh(r, 9)
    rows = [(i, " ".join(fresh(r, 20) + phrase * 20 + fresh(r, 14))) for i in range(6)]
    base = fresh(r, 60)
    rows += [(10, " ".join(base + phrase)), (11, " ".join(base + phrase * 30))]
    assert brute(rows) == {**{i: i for i in range(6)}, 10: 10, 11: 10}
    assert groups(spark, rows) == brute(rows)


def test_odd_rows_of_near_groups(spark):
    """Null, empty and blank texts, short ones, a very long one, repeated rows, rows without an id and clashing columns."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one three"), (7, long), (8, long + " more"), (8, long + " more"), (None, "one two"), (9, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "kept", 0, "x") for i, t in rows], "doc_id long, text string, sig string, group_id int, _kept string")
    got = sorted((r.doc_id, r.group_id) for r in simhash.near_groups(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (8, 7), (9, 9)]
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r.sig, r.group_id, r._kept) for r in kept) == [(i, "kept", 0, "x") for i in (0, 1, 4, 6, 7, 9)]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_kept_rows_follow_fingerprints(spark):
    """Texts whose fingerprints are linked are one group, though their shingles are too few alike for the comparison by texts."""
    rows = [(1, "a b c d e f"), (2, "f e d c b a"), (3, "one two three four five six seven")]
    base = " ".join(f"w{i}" for i in range(40))
    near = [(10 + i, " ".join(f"x{i}" if j == 20 else w for j, w in enumerate(base.split()))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (4, base), *near], "doc_id long, text string")
    fps = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in [*rows, (4, base), *near]}
    linked = {i for i, _ in near if (fps[i] ^ fps[4]).bit_count() <= 2}
    assert linked and all(simhash.jaccard(base, dict(near)[i]) < simhash.SIMILARITY for i in linked)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert 4 in kept and not kept & linked and {1, 2, 3} <= kept


def test_finished_components_take_no_step(spark, monkeypatch):
    from tallyforge.llm import components as c

    names, stored = [], c.stored
    monkeypatch.setattr(c, "stored", lambda df, name: names.append(name) or stored(df, name))
    star = spark.createDataFrame([(2, 1), (1, 3), (7, 5), (None, 4), (6, 6)], "u long, v long")
    assert {tuple(r) for r in c.components(star, "x").collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)} and names == ["x-links"]
    chain = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert {tuple(r) for r in c.components(chain, "y").collect()} == {(1, 1), (2, 1), (3, 1)} and names[1:] == ["y-links", "y-step"]
