"""Hierarchical packing of documents into training sequences.

Each text is tokenised once; what goes on is its length and running checksums of its ids at
every CUT-th place, from which the checksum of any piece follows. Whole windows of the longest tier are
cut off long documents; what remains is routed to the smallest context tier that holds it. Documents are dealt
into groups of bounded size by a hash, and each group is packed by itself, tier by tier from the
longest: a tier's documents open windows of that tier's size, gaps are filled from the longest
documents of shorter tiers that fit, and a gap that none fits is closed by cutting one where a
checksum is known; what is left of it is routed anew. Windows of the shorter tiers are full to the last
token, so that they need no padding; what can't be made so goes to windows of the longest tier, which may be padded. Sequences
are then dealt into step groups of like tokens and tiers.

Null and empty texts are the end token alone. Repeated rows are packed once each; equal lengths are
taken in order of id and checksum, so that ties don't depend on how rows came. An empty
table gives an empty result. Texts of any length are one row each and are never joined. Columns other
than the id and the text aren't looked at.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, table

TIERS, CUT, SLACK, END, STEP = (256, 512, 1024, 2048), 64, 8, 1, 8
WINDOW = TIERS[-1]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
#: Words kept in each of a worker's two generations of cached ids, and the longest word kept.
CACHED, LONGEST = 350_000, 48


#: Texts that a tokenizer must encode word by word as it does whole; one that doesn't is asked for whole texts.
SAMPLES = (
    "Two words, and MORE: it's 3.5% of\n\tx_1  y!",
    "  Été Straße\u00a0ΟΔΟΣ İx ﬁ 漢字かな\U0001f600 ", "don't e.g. a-b (c) \"d\" <s> ... 12,345 fooBAR?! \u0301e", "",
    "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])) + "###", "a!!b&& c--(d) `x` {y}~ z_9$% 3a4b @e;:/\\|^]>=*+ \u00aa\u00d7\u00b5",
)


class WordTokens:
    """Ids of texts as little-endian bytes. Where no token crosses a blank, words are encoded once and looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.tokenize = whole.encode_batch_fast, whole.model.tokenize
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_word = True
        self.by_word = all(self.ids(t) == self._whole(t) for t in SAMPLES)

    def _whole(self, text: str) -> bytes:
        return array("I", self.encode([text], add_special_tokens=False)[0].ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        words = text.replace("\n", " ").replace("\t", " ").split(" ")
        fresh = set(words).difference(self.young)
        if not fresh:
            return b"".join(map(self.young.__getitem__, words))
        got = self._learn(fresh)
        if all(len(w) <= LONGEST for w in fresh):
            return b"".join(map(self.young.__getitem__, words))
        return b"".join([got[w] if w in got else self.young[w] for w in words])

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that weren't found. Those of plain letters, digits and marks are cut here and asked of the model alone; the tokenizer's own rules take the others."""
        got, others = {}, []
        for w in words:
            x = self.old.get(w)
            if x is None:
                if not _PLAIN(w):
                    others.append(w)
                    continue
                pieces = _PIECES(w.lower())
                x = self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self._piece(p) for p in pieces])
            got[w] = x
        for w, e in zip(others, self.encode(others, add_special_tokens=False), strict=True):
            got[w] = array("I", e.ids).tobytes()
        self.young.update((w, x) for w, x in got.items() if len(w) <= LONGEST)
        return got

    def _piece(self, p: str) -> bytes:
        x = self.young.get(p)
        if x is None:
            x = self.old.get(p)
            if x is None:
                x = array("I", [t.id for t in self.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            if len(p) <= LONGEST:
                self.young[p] = x
        return x


#: Words of ASCII and Latin-1 letters, digits and marks, less those of contractions and special tokens; such a word's pieces; and letters that stand for bytes.
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
_PLAIN = re.compile(rf"[{_LETTERS}0-9!-&(-/:;=-@\\\]-`{{-~]+").fullmatch
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall
_BYTES = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_LOADED: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One per worker process, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def marks(ids: bytes, cut: int = CUT) -> bytes:
    """CRC-32 of the first cut, 2*cut, ... ids and of all of them."""
    out, crc = array("I"), 0
    for i in range(0, len(ids), 4 * cut):
        crc = zlib.crc32(ids[i : i + 4 * cut], crc)
        out.append(crc)
    return out.tobytes()


def piece_crc(known: array, start: int, end: int, cut: int = CUT) -> int:
    """CRC-32 of ids start to end from running ones: that of the longer prefix, less the shorter's moved on by as many zero bytes."""
    last = known[-(-end // cut) - 1]
    if not start:
        return last
    moved = zlib.crc32(bytes(4 * (end - start)), known[start // cut - 1] ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return last ^ moved


def lengths(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n: ids with the end token, marks)."""
    end = array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for b in batches:
            ids = (tokens.ids(t.as_py() or "") + end for t in b.column(1))
            n, crcs = zip(*((len(x) // 4, marks(x)) for x in ids), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.binary())], ["doc_id", "n", "marks"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, marks binary")


class _Pool:
    """A tier's remainders (length, document, start), by length and by length modulo CUT."""

    def __init__(self) -> None:
        self.all: list[tuple] = []
        self.by: dict[int, list] = {}

    def add(self, x: tuple) -> None:
        insort(self.all, x)
        insort(self.by.setdefault(x[0] % CUT, []), x)

    def take(self, x: tuple) -> tuple:
        del self.all[bisect_left(self.all, x)]
        same = self.by[x[0] % CUT]
        del same[bisect_left(same, x)]
        return x

    def longest(self, most: int) -> tuple | None:
        i = bisect_left(self.all, (most + 1,))
        return self.all[i - 1] if i else None

    def tail(self, gap: int) -> tuple | None:
        """The shortest one over gap of which the last gap ids can be cut off."""
        same = self.by.get(gap % CUT, [])
        i = bisect_left(same, (gap + 1,))
        return same[i] if i < len(same) else None


def tier_of(length: int) -> int:
    return next(t for t in TIERS if length <= t)


class _Tiers:
    """Remainders, each in the pool of the smallest tier that holds it."""

    def __init__(self, items: list[tuple[int, int, int]]):
        self.pools = {t: _Pool() for t in TIERS}
        for x in sorted(items):
            self.add(x)

    def add(self, x: tuple) -> None:
        self.pools[tier_of(x[0])].add(x)

    def take(self, x: tuple) -> tuple:
        return self.pools[tier_of(x[0])].take(x)

    def longest(self, most: int) -> tuple | None:
        return next((x for t in reversed(TIERS) if t // 2 < most or t == TIERS[0] if (x := self.pools[t].longest(most))), None)

    def tail(self, gap: int) -> tuple | None:
        return next((x for t in TIERS if t > gap if (x := self.pools[t].tail(gap))), None)

    def fill(self, gap: int) -> list[tuple[int, int, int]]:
        """Pieces (document, start, length) that close a gap, as far as that can be done."""
        out = []
        while gap:
            if whole := self.longest(gap):
                length, d, start = self.take(whole)
            elif x := self.tail(gap):
                rest, d, start = self.take(x)
                self.add((rest - gap, d, start))
                length, start = gap, start + rest - gap
            elif gap >= CUT and (x := self.longest(WINDOW)):
                rest, d, start = self.take(x)
                length = gap - gap % CUT
                self.add((rest - length, d, start + length))
            else:
                break
            out.append((d, start, length))
            gap -= length
        return out


def pack(n: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, its pieces: document, start, length) for each sequence; n: the documents' lengths."""
    out = [(WINDOW, [(d, s, WINDOW)]) for d, m in enumerate(n) for s in range(0, m - m % WINDOW, WINDOW)]
    tiers = _Tiers([(m % WINDOW, d, m - m % WINDOW) for d, m in enumerate(n) if m % WINDOW])
    left: list[tuple[int, int, int]] = []
    for tier in reversed(TIERS):
        pool = tiers.pools[tier]
        while pool.all:
            length, d, start = pool.take(pool.all[-1])
            window = [(d, start, length), *tiers.fill(tier - length)]
            if sum(x[2] for x in window) >= tier - (SLACK if tier == WINDOW else 0):
                out.append((tier, window))
            else:
                left += [(x[2], x[0], x[1]) for x in window]
    rest = _Tiers(left)
    while x := rest.longest(WINDOW):
        length, d, start = rest.take(x)
        out.append((WINDOW, [(d, start, length), *rest.fill(WINDOW - length)]))
    return out


def steps(sequences: list[tuple[int, list[tuple]]]) -> list[int]:
    """A step group of about STEP windows' tokens for each sequence: dealt there and back in order of tier and tokens."""
    tokens = [sum(x[2] for x in pieces) for _, pieces in sequences]
    groups = max(1, sum(tokens) // (STEP * WINDOW))
    out = [0] * len(sequences)
    for k, i in enumerate(sorted(range(len(sequences)), key=lambda i: (sequences[i][0], tokens[i]), reverse=True)):
        lap, at = divmod(k, groups)
        out[i] = at if lap % 2 == 0 else groups - 1 - at
    return out


def pack_group(part: pd.DataFrame) -> pd.DataFrame:
    """Packs one group; its documents in order of id and length, so that the result doesn't depend on how rows came."""
    part = part.sort_values(["doc_id", "n", "marks"], kind="stable")
    ids, n = part["doc_id"].tolist(), part["n"].tolist()
    known = [array("I", x) for x in part["marks"]]
    base, rows = int(part["group"].iloc[0]) << 32, []
    sequences = pack(n)
    for k, ((tier, pieces), step) in enumerate(zip(sequences, steps(sequences), strict=True)):
        offset = 0
        for d, start, length in pieces:
            rows.append((ids[d], start, length, piece_crc(known[d], start, start + length), n[d], base + k, offset, tier, base + step))
            offset += length
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def pack_documents(docs: DataFrame, path: str, group_docs: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece (see PIECES); group_docs: documents in a packing group, about."""
    known = stored(lengths(docs, path, key, text), "packing-lengths")
    groups = max(1, -(-known.count() // group_docs))
    dealt = known.withColumn("group", F.pmod(F.xxhash64("doc_id", "n", "marks"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack_group, PIECES)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), path or vocabulary())
