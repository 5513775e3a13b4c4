"""Spelling variants: words one edit apart, grouped below their commonest form.

A word is arranged by how many of its letters fall into each of GROUPS, one after another: these counts are a path in a
trie, its frequency vector. A word and one made of it by an edit differ by at most one letter too many in one group and one too few
in another. The search goes down the trie depth first with a budget of one surplus and one deficit; words at the leaves that it
reaches are verified letter by letter. As nearness has no direction, a search spends its deficit before its surplus, so that of two
words one finds the other.

The top of the trie is walked by joins: words are dealt to nodes at the depths STOPS, searches to the nodes that their budget reaches. A node
of at most NODE words is searched in one task, by a trie of its own. A larger one is opened down to the next stop. Nodes that are
too large at the last one are dealt out by words' first letters and, once more, by their last: an edit leaves one of both alone.

Null and empty texts have no words. Null ids count as empty in the hash. Texts of any length are read whole, in slices cut where no
word is. Words of equal counts (ties) are taken in code-point order. Repeated rows count as often as they occur. An empty table gives an
empty result. Columns other than the id and the text aren't looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add, ne

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, table

LEAST_LETTERS, LEAST_COUNT, TIMES, DROPPED = 6, 5, 5, 199
#: Letters of a level of the trie; the last level is all others.
GROUPS = ("ae", "io", "un", "rt", "sl", "dc", "mg", "pbf", "hvwkjqxyz")
LEVELS = len(GROUPS) + 1
STOPS, NODE, ANCHOR = (2, 4, 6, 8, LEVELS), 4096, 3
LEAF, SLICE, KEPT = 16, 1 << 20, 1 << 18
_RUN, _GAP = re.compile("[a-zÀ-ÿ]+"), re.compile("[^a-zÀ-ÿ]")
_TO_LEVEL = str.maketrans({c: chr(65 + i) for i, g in enumerate(GROUPS) for c in g} | {chr(c): chr(65 + len(GROUPS)) for c in range(0xC0, 0x100)})


def runs(text: str) -> Iterator[Counter]:
    """Lower-cased runs of letters of each slice."""
    text, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield Counter(_RUN.findall(text, at, end))
        at = end


def dropped(prefix: int, run: str) -> str:
    """run, less a letter where the hash says so; prefix: the CRC-32 of what comes before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DROPPED:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with at least that many occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                prefix = zlib.crc32(f"{k.as_py() or ''}:".encode())
                for some in runs(t.as_py() or ""):
                    for w, n in some.items():
                        w = dropped(prefix, w)
                        if len(w) >= LEAST_LETTERS:
                            held[w] += n
                if len(held) > KEPT:
                    yield out()
        yield out()

    found = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def vector(word: str) -> list[int]:
    levels = word.translate(_TO_LEVEL)
    return [levels.count(chr(65 + i)) for i in range(LEVELS)]


def near(a: str, b: str) -> bool:
    """Exactly one code point deleted of a, or replaced; b isn't the longer one."""
    if a[:ANCHOR] != b[:ANCHOR] and a[-ANCHOR:] != b[-ANCHOR:]:
        return False  # words have twice as many letters at least, and an edit leaves one end alone
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == b[i:]


class Trie:
    """Words by their length, then by their vectors. Nodes of at most LEAF words have no further levels; larger leaves hold words by their halves."""

    def __init__(self, words: dict[str, int]):
        by_length: dict[int, list] = {}
        for w, n in words.items():
            by_length.setdefault(len(w), []).append((tuple(vector(w)), w, n))
        self.roots = {length: self._grow(items, 0) for length, items in by_length.items()}

    def _grow(self, items: list, level: int) -> list | dict:
        if len(items) <= LEAF:
            return items
        below: dict = {}
        if level == LEVELS:
            for x in items:
                for half in self._halves(x[1], len(x[1]) // 2, len(x[1])):
                    below.setdefault(half, []).append(x)
            return below
        for x in items:
            below.setdefault(x[0][level], []).append(x)
        return {c: self._grow(some, level + 1) for c, some in below.items()}

    @staticmethod
    def _halves(word: str, at: int, length: int) -> tuple:
        """The first and the last letters of word, as many as the halves of a word of that length have."""
        return word[:at], (word[-(length - at) :],)

    def reach(self, word: str) -> Iterator[tuple[str, int]]:
        """Words near word that this one must find: shorter ones, those of a lesser vector, and those of the same one that come before it."""
        v = tuple(vector(word))
        for length, most in ((len(word), 2), (len(word) - 1, 1)):
            todo = [(self.roots[length], 0, 0)] if length in self.roots else []
            while todo:
                node, level, spent = todo.pop()
                if type(node) is list:
                    yield from self._verified(node, word, v)
                    continue
                if level == LEVELS:
                    found = (x for half in self._halves(word, length // 2, length) for x in node.get(half, ()))
                    yield from self._verified({x[1]: x for x in found}.values(), word, v)
                    continue
                c = v[level]
                if (below := node.get(c)) is not None:
                    todo.append((below, level + 1, spent))
                if spent < most and (below := node.get(c + (1 if spent else -1))) is not None:
                    todo.append((below, level + 1, spent + 1))

    @staticmethod
    def _verified(found: Iterable[tuple], word: str, v: tuple) -> Iterator[tuple[str, int]]:
        for x, w, n in found:
            if near(word, w) and (len(w) < len(word) or (x, w) < (v, word)):
                yield w, n


def search(words: pd.DataFrame, searches: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of one node."""
    trie = Trie(dict(zip(words["word"], words["n"], strict=True)))
    rows = [(a, an, b, bn) for a, an in zip(searches["sought"], searches["sought_n"], strict=True) for b, bn in trie.reach(a)]
    return pd.DataFrame(rows, columns=["a", "an", "b", "bn"])


def steps(width: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(spent before, spent after, change of each count) over so many levels."""
    out = [(s, s, (0,) * width) for s in range(3)]
    one = lambda *at: tuple(dict(at).get(i, 0) for i in range(width))
    for i in range(width):
        out += [(0, 1, one((i, -1))), (1, 2, one((i, 1)))]
        out += [(0, 2, one((i, -1), (j, 1))) for j in range(i + 1, width)]
    return out


def near_pairs(words: DataFrame, node: int = NODE) -> DataFrame:
    """(a, an, b, bn): each two near words once, with their counts; words: (word, n), each word once."""
    letters = F.length("word")
    levels = [(letters - F.length(F.translate("word", g, ""))).cast("int") for g in GROUPS]
    words = words.select("word", "n", F.array(*levels, (letters - reduce(add, levels)).cast("int")).alias("v"))
    searches = words.withColumns({"path": F.array().cast("array<int>"), "spent": F.lit(0)})
    index_parts, search_parts, before = [], [], 0
    for stop in STOPS:
        options = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.array(*map(F.lit, d)).alias("d")) for a, b, d in steps(stop - before)))
        part = F.slice("v", before + 1, stop - before)
        went = searches.withColumn("o", F.explode(F.filter(options, lambda o: o["a"] == F.col("spent"))))
        went = went.select("word", "n", "v", F.concat("path", F.zip_with(part, "o.d", lambda x, y: x + y)).alias("path"), F.col("o.b").alias("spent"))
        index = words.withColumn("path", F.slice("v", 1, stop))
        sizes = stored(index.groupBy("path").agg((F.count("*") > node).alias("large")), "spelling-nodes")
        index, went = index.join(sizes, "path"), went.join(sizes, "path")
        key = F.concat_ws(",", F.col("path").cast("array<string>")).alias("node")
        index_parts.append(index.where(~F.col("large")).select(key, "word", "n"))
        search_parts.append(went.where(~F.col("large")).select(key, "word", "n"))
        if sizes.where("large").isEmpty():
            break
        words = stored(index.where("large").select("word", "n", "v"), "spelling-words")
        searches = stored(went.where("large").select("word", "n", "v", "path", "spent"), "spelling-searches")
        before = stop
    else:
        key = F.concat_ws(",", F.col("path").cast("array<string>"))
        ends = F.explode(F.array(F.concat(F.lit(">"), F.substring("word", 1, ANCHOR)), F.concat(F.lit("<"), F.substring("word", -ANCHOR, ANCHOR))))
        for parts, rows in ((index_parts, words.withColumn("path", F.col("v"))), (search_parts, searches)):
            parts.append(rows.withColumn("end", ends).select(F.concat(key, "end").alias("node"), "word", "n"))
    index, searches = (reduce(DataFrame.unionByName, parts) for parts in (index_parts, search_parts))
    searches = searches.toDF("at", "sought", "sought_n")
    return index.groupBy("node").cogroup(searches.groupBy("at")).applyInPandas(search, "a string, an long, b string, bn long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), by following twice as many forms each time; counts grow along forms, so that none comes back."""
    known = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while not known.where("open").isEmpty():
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        known = stored(known.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")), "spelling-roots")
    return known.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, node: int = NODE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from (word, n)."""
    pairs = stored(near_pairs(words, node), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("m"), F.col("b").alias("w")).alias("x")).unionAll(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("an")).alias("m"), F.col("a").alias("w")).alias("x"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("x").alias("x"))
    follows = -F.col("x.m") >= F.col("n") * times
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("x.w")).alias("form"), F.when(follows, -F.col("x.m")).alias("form_n"))
    found = stored(found, "spelling-forms")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(stored(vocabulary(table(spark, sf_dir, "documents")), "spelling-vocabulary"))
