"""Proximity matches against brute force over all choices of postings."""

import random
from itertools import product

from tallyforge.llm import decontaminate


def test_proximity(spark):
    r = random.Random(6)
    lists = [(1, [0, 4], 100, 7, shift, bit) for shift, bit in ((0, 1), (3, 1), (5, 2))]
    for doc in range(200):
        lists += [(2, [1, 3], doc, 7, r.randint(0, 40), r.choice([1, 2])) for _ in range(r.randint(1, 8))]
        lists += [(3, [0, 2, 7], doc, 7, r.randint(0, 25), r.choice([1, 2, 4])) for _ in range(r.randint(1, 9))]
    at = {}
    for row, qs, doc, _, shift, bit in lists:
        at.setdefault((row, doc), [[] for _ in qs])[bit.bit_length() - 1].append(shift)
    want = {k for k, places in at.items() if any(max(c) - min(c) <= 3 for c in product(*places))}
    got = [(x.row, x.doc_id) for x in decontaminate.proximity(spark.createDataFrame(lists, "row long, qs array<int>, doc_id long, sig long, shift int, bit int"), 3).collect()]
    assert (1, 100) in want and len(got) == len(set(got)) and set(got) == want


def test_rows_of_one_id_and_items_without_one(spark):
    phrase = "alpha brook cedar delta ember frost grove haven inlet jolly"
    docs = spark.createDataFrame([(1, phrase), (1, f"x {phrase} {phrase}"), (1, f"x {phrase} {phrase}"), (1, "nothing"), (None, phrase), (2, "x " * 100_000 + phrase)], "doc_id long, text string")
    items = spark.createDataFrame([(None, phrase), (7, phrase), (8, "frost grove")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contaminated(docs, items).collect())
    assert got[1:4] == [(1, 1, 0, ""), (1, 10, 10, "7,8"), (1, 21, 20, "7,8")] and got[4] == got[3] and got[5] == (2, 100_010, 10, "7,8")
