"""Line dedup against its definition: what repeats goes, what goes stays elsewhere, all else stays."""

import random
import time

import pytest

from tallyforge.llm import linededup
from tests.llm.conftest import prose


def texts(seed, n=90, words=(2, 30)):
    """Documents of own lines with passages of shared lines in them, cut and shifted at random."""
    r = random.Random(seed)
    pool = [[prose(1000 * seed + 40 * p + k, r.randint(*words)) for k in range(r.randint(1, 9))] for p in range(12)]
    out = []
    for i in range(n):
        lines = []
        for part in range(r.randint(1, 5)):
            if r.random() < 0.5:
                lines += [prose(10**6 + 100 * i + 10 * part + k, r.randint(1, 12)) + f" own{i}-{part}-{k}" for k in range(r.randint(0, 4))]
            else:
                p = r.choice(pool)
                lines += [r.choice(["", " "]) + x for x in p[r.choice([0, 0, r.randint(0, len(p) - 1)]) :]]
            lines += [""] * r.choice([0, 0, 0, 1])
        out.append("\n".join(lines))
    return out


def runs_that_repeat(docs, least):
    """(document, line) for each line of a run of at least so many words whose bytes occur earlier, without overlap."""
    seen, out = {}, set()
    for d, text in enumerate(docs):
        lines = [x.strip() for x in text.split("\n")]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least and lines[a] and lines[b - 1]:
                    e, at = seen.setdefault(tuple(lines[a:b]), (d, a))
                    if (e, at) != (d, a):
                        out |= {(d, k) for k in range(a if e < d else max(a, at + b - a), b)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_long_passages_go_whole(spark, seed):
    docs = texts(seed)
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], "doc_id long, text string, _gone string, sig string")).collect()}
    must, pairs = runs_that_repeat(docs, linededup.PASSAGE_WORDS), {}
    for d, text in enumerate(docs):
        lines = [x.strip() for x in text.split("\n")]
        for k in range(len(lines) - 1):
            pairs.setdefault((lines[k], lines[k + 1]), []).append((d, k))
    repeated = {(d, k + o) for at in pairs.values() if len(at) > 1 for d, k in at for o in (0, 1)}  # lines of some repeated pair: chunks have two lines or more
    assert len(must) > 100
    left = set()
    for d, text in enumerate(docs):
        lines, kept = text.split("\n"), got[d].text.split("\n")
        assert got[d].lines_removed == len(lines) - (len(kept) if got[d].text or got[d].lines_removed < len(lines) else 0) and (got[d]._gone, got[d].sig) == ("x", "y")
        left |= {x.strip() for x in kept}
        sure = [x for k, x in enumerate(lines) if (d, k) not in repeated and (d, k) not in must]
        may = [x for k, x in enumerate(lines) if (d, k) not in must]
        rest = iter(kept)
        assert all(x in rest for x in sure)  # in order
        rest = iter(may)
        assert all(x in rest for x in kept if got[d].text)
    assert left >= {x.strip() for t in docs for x in t.split("\n")}


@pytest.mark.parametrize("lines", [1, 2, 3, 4, 6, 12])
def test_passages_of_any_line_length(spark, lines):
    passage = [prose(50 + k, -(-60 // lines)) for k in range(lines)]
    rows = [(i, "\n".join([prose(7 * i + 1, 9), *passage, prose(7 * i + 3, 9)])) for i in range(3)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i].split("\n") == [rows[i][1].split("\n")[0], rows[i][1].split("\n")[-1]] for i in (1, 2))


def test_chunks_alone_against_one_pass(spark):
    """With passages off: chunks in order of place, each removed where its bytes came before. The cutting rule is written out anew."""
    import xxhash

    docs = texts(3, 120, (1, 4))

    def ends(lines):
        h, start = [xxhash.xxh3_64_intdigest(x.strip()) for x in lines], 0
        for i in range(len(h)):
            x = (h[i] + (h[i - 1] * linededup._MULTIPLIER if i else 0)) % 2**64
            mixed = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) % 2**64
            if i + 1 - start >= 2 and mixed / 2**64 < 1 / 2 or i + 1 - start >= 32 or i + 1 == len(h):
                yield start, i + 1
                start = i + 1

    seen, want, removed = set(), {}, {}
    for d, text in enumerate(docs):
        lines, out = text.split("\n"), []
        for a, b in ends(lines):
            body = tuple(x.strip() for x in lines[a:b])
            if b - a < 2 or not any(body) or body not in seen:
                out += lines[a:b]
            seen.add(body)
        want[d], removed[d] = "\n".join(out), len(lines) - len(out)
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), passage_words=None).collect()
    assert {r.doc_id: r.text for r in got} == want and {r.doc_id: r.lines_removed for r in got} == removed and sum(removed.values()) > 50


def test_a_line_many_times_and_a_long_text(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, "\n".join([line] * 23)), (2, None), (3, ""), (4, "\n".join(prose(k, 6) + f" {k}" for k in range(20_000)))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] is None and got[3] == "" and got[4] == rows[3][1]
    assert set(got[1].split("\n")) == {line} and 5 <= len(got[1].split("\n")) < 23


def test_chunk_ends_resist_shifts():
    lines = [prose(i, 6) for i in range(60)]
    a, b = (linededup.chunk_ends(linededup.line_hashes(x)) for x in (lines, ["new line", *lines]))
    assert len(set(a) & {e - 1 for e in b}) >= 0.8 * len(a)


def test_passages_of_many_lines_take_linear_time():
    """A million lines, many of them blank, in seconds; the same runs as by trying all."""
    r = random.Random(1)
    for _ in range(300):
        words = [r.choice([0, 0, 1, 3, 9]) for _ in range(r.randint(0, 14))]
        want = set()
        for e in range(len(words)):
            firsts = [f for f in range(e + 1) if sum(words[f : e + 1]) >= 10 and words[f]]
            want |= {(max(firsts), e + 1)} if firsts and words[e] else set()
        for f in range(len(words)):
            ends = [e for e in range(f, len(words)) if sum(words[f : e + 1]) >= 10 and words[e]]
            want |= {(f, min(ends) + 1)} if ends and words[f] else set()
        assert linededup.passages(words, 10) == want
    began = time.perf_counter()
    assert len(linededup.passages([r.choice([0, 5, 12]) for _ in range(1_000_000)], 50)) > 500_000
    assert time.perf_counter() - began < 20
