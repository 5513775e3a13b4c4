"""Packing: every id in one piece, real tiers, gaps filled from shorter ones, little padding, level steps."""

import random
from collections import defaultdict

import pytest

from tallyforge.llm import packing
from tallyforge.llm.packing import CUT, TIERS, WINDOW

r = random.Random(1)
CASES = {
    "mixed": [int(r.lognormvariate(6, 1.1)) + 1 for _ in range(3000)], "short": [r.randint(1, 200) for _ in range(3000)], "long": [r.randint(1500, 2047) for _ in range(500)],
    "alike": [700] * 1000, "one": [5], "none": [], "whole windows": [20000, 2048, 2049, 4096], "few": [200] * 8 + [300] * 4 + [900] * 2 + [1500],
}


def padding(sequences):
    used = [sum(x[2] for x in pieces) for _, pieces in sequences]
    return sum(WINDOW - u for u in used if u & (u - 1))


@pytest.mark.parametrize("name", CASES)
def test_each_id_lies_in_one_piece(name):
    n, pieces = CASES[name], defaultdict(list)
    for tier, sequence in packing.pack(n):
        used = sum(x[2] for x in sequence)
        assert used == tier or tier == WINDOW and 0 < used <= WINDOW  # shorter tiers are full
        for d, start, length in sequence:
            pieces[d].append((start, length))
    for d, m in enumerate(n):
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0 and start % CUT == 0 and ((start + length) % CUT == 0 or start + length == m)
            at += length
        assert at == m


def test_tiers_padding_and_steps():
    n = CASES["mixed"]
    sequences = packing.pack(n)
    tiers = {t: [s for x, s in sequences if x == t] for t in TIERS}
    assert all(len(tiers[t]) > 50 for t in TIERS) and padding(sequences) < 0.002 * sum(n)
    for t in TIERS[1:]:
        # a window is opened by a document of its own tier, and its gap filled from shorter ones
        opened = [s for s in tiers[t] if s[0][2] < t]
        assert sum(t // 2 < s[0][2] for s in opened) > 0.75 * len(opened)
        assert sum(all(x[2] <= t // 2 for x in s[1:]) for s in opened) > 0.75 * len(opened)
    step = packing.steps(sequences)
    tokens, kinds = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for (t, s), k in zip(sequences, step, strict=True):
        tokens[k] += sum(x[2] for x in s)
        kinds[t][k] += 1
    assert max(tokens.values()) - min(tokens.values()) <= WINDOW
    assert all(max(by.get(k, 0) for k in tokens) - min(by.get(k, 0) for k in tokens) <= 2 for by in kinds.values())


@pytest.mark.parametrize("name", ["short", "long", "alike"])
def test_little_padding(name):
    assert padding(packing.pack(CASES[name])) < 0.01 * sum(CASES[name])


def test_a_tokenizer_that_joins_words_is_asked_for_whole_texts(tmp_path):
    from array import array

    from tokenizers import Tokenizer, models

    vocabulary = {"<unk>": 0, "a": 1, " ": 2, "b": 3, "a ": 4, "a b": 5}
    Tokenizer(models.BPE(vocabulary, [("a", " "), ("a ", "b")], unk_token="<unk>")).save(f"{tmp_path}/t.json")
    own = packing.WordTokens(f"{tmp_path}/t.json")
    assert not own.by_word and own.ids("a bb") == array("I", [5, 3]).tobytes()
    assert packing.WordTokens(packing.vocabulary()).by_word


def test_plain_words_are_asked_of_the_model_alone():
    """Only words of contractions, special tokens and other scripts go through the tokenizer's rules."""
    own = packing.WordTokens(packing.vocabulary())
    text = "Größe RUN!! ###stop ciónà(x) a_b 3.5% “quoted” she's <|endoftext|> ª2 漢字 éx"
    asked, whole = [], own.encode
    own.encode = lambda words, **kw: asked.extend(words) or whole(words, **kw)
    got = own.ids(text)
    own.encode = whole
    assert got == own._whole(text)
    assert {"Größe", "RUN!!", "###stop", "ciónà(x)", "a_b", "3.5%"}.isdisjoint(asked) and {"she's", "<|endoftext|>", "漢字"} <= set(asked)
