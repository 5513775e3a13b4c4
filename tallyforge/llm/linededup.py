"""Line deduplication by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last lines' hashes ends a chunk where it is zero
modulo the mean chunk length. A chunk's ends depend on the lines around them alone, so a passage that
is shifted or copied into another document is cut at the same places again. Chunks whose
hash repeats anywhere are grouped by their bytes; of equal chunks the first (least document,
then place) stays and the others' lines go. Chunks of one line, and of blank lines alone, stay.

At the edges of a copied passage chunks hold foreign lines, so what repeats there isn't found. Long passages
are found whole by an addition that passage_words sets (None: chunks alone): runs of lines with at least that many words,
each as short as can be, from every line on and up to every line. All such runs that repeat are treated as equal chunks are, so a
repeated passage goes whole, however its lines are cut.

Lines are compared without blanks at their ends. Null and empty texts stay as they are; a
document all of whose lines repeat keeps an empty text. Every line that goes has an equal that stays. Texts of any length are
cut whole. Rows of one id are told apart by
their text; rows equal in both are treated alike, so the first occurrence stays in each. Rows without an id stay whole. Ties don't
arise, as places differ. Other columns pass through, whatever their names; ``lines_removed`` is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import let, stored, table

#: Lines that the rolling hash looks at, mean lines of a chunk beyond its least, least and most lines of a chunk.
SPAN, MEAN, LEAST, MOST = 2, 2, 2, 32
#: Words of a passage that is removed whole where it repeats.
PASSAGE_WORDS = 50
_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) for x in lines]


def chunk_ends(hashes: list[int], span: int = SPAN, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends, exclusive, of the chunks that lines with these hashes are cut into."""
    ends: list[int] = []
    rolling, top, start = 0, pow(_MULTIPLIER, span, 1 << 64), 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _MULTIPLIER + h) & _MASK
        if i >= span:
            rolling = (rolling - hashes[i - span] * top) & _MASK
        size = i + 1 - start
        if size >= least and ((rolling ^ rolling >> 29) * 0xBF58476D1CE4E5B9 & _MASK) >> 33 < (1 << 31) // mean or size >= most:
            ends.append(i + 1)
            start = i + 1
    if start < len(hashes):
        ends.append(len(hashes))
    return ends


def passages(words: list[int], least: int) -> set[tuple[int, int]]:
    """(first, end) of the shortest runs of lines with at least so many words, from each line on and up to each line; they neither begin nor end with a line of none."""
    found, first, total = set(), 0, 0
    for end, n in enumerate(words):
        total += n
        while total - words[first] >= least:
            total -= words[first]
            first += 1
        if total >= least and n:
            while not words[first]:
                first += 1
            found.add((first, end + 1))
    last, total = len(words) - 1, 0
    for first in range(len(words) - 1, -1, -1):
        total += words[first]
        while total - words[last] >= least:
            total -= words[last]
            last -= 1
        if total >= least and words[first]:
            while not words[last]:
                last -= 1
            found.add((first, last + 1))
    return found


_CHUNK = "doc_id long, sig long, first int, n int, h binary"


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, sig, text); sig tells rows of one id apart."""
    whole = F.col(text).cast("string")
    return docs.where(whole != "").select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(whole).alias("sig"), whole.alias("text"))


#: Bytes of runs of lines that a worker gathers before it hands them on.
HELD = 4 << 20


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


_KINDS = {"doc_id": pa.int64(), "sig": pa.int64(), "first": pa.int32(), "n": pa.int32(), "h": pa.binary()}


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, sig, first: the chunk's first line, n: its lines, h: 128-bit hash of its lines) for each chunk or passage that may go."""

    def cut(d: int, sig: int, whole: str) -> Iterator[tuple]:
        lines = [x.strip() for x in whole.split("\n")]
        hashes, start, found = line_hashes(lines), 0, set()
        for end in chunk_ends(hashes):
            if end - start > 1 and any(lines[start:end]):
                found.add((start, end))
            start = end
        if passage_words:
            found |= passages([len(x.split()) for x in lines], passage_words)
        packed = array("Q", hashes).tobytes()
        for start, end in found:
            yield d, sig, start, end - start, xxhash.xxh3_128_digest(packed[8 * start : 8 * end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)
            yield _batch([x for d, sig, t in rows for x in cut(d, sig, t.as_py())], _KINDS)

    return _keyed(docs, key, text).mapInArrow(run, _CHUNK)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, sig, first, n): runs of lines to remove. Their bytes are equal to those of an earlier chunk; they don't reach into that one."""
    found = stored(chunks(docs, key, text, passage_words), "linededup-chunks")
    often = found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    again = found.join(often, "h")
    wanted = again.groupBy("doc_id", "sig").agg(F.collect_list(F.struct("first", "n", "h")).alias("c"))  # a document's own chunks
    texts = _keyed(docs, key, text).join(wanted.hint("merge"), ["doc_id", "sig"]).select("doc_id", "sig", "c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0  # runs overlap, so that they are larger than their texts
        for b in batches:
            for d, sig, c, t in zip(*b.columns, strict=True):
                lines = [x.strip() for x in t.as_py().split("\n")]
                for x in c:
                    first, n = x["first"].as_py(), x["n"].as_py()
                    body = "\n".join(lines[first : first + n]).encode()
                    rows.append((d.as_py(), sig.as_py(), first, n, x["h"].as_py(), body))
                    held += len(body)
                    if held > HELD:
                        yield _batch(rows, _KINDS | {"body": pa.binary()})
                        rows, held = [], 0
        yield _batch(rows, _KINDS | {"body": pa.binary()})

    bodies = stored(texts.mapInArrow(run, f"{_CHUNK}, body binary"), "linededup-bodies")
    place = F.struct("doc_id", "sig", "first", "n")
    kept = bodies.groupBy("h").agg(F.min(place).alias("kept"), F.min_by("body", place).alias("kept_body"))
    same = bodies.alias("b").join(kept.alias("k"), F.expr("b.h = k.h AND b.body = k.kept_body AND struct(b.doc_id, b.sig, b.first, b.n) <> k.kept"))
    own = F.expr("b.doc_id = k.kept.doc_id AND b.sig = k.kept.sig")
    start = F.when(own, F.greatest("b.first", F.expr("k.kept.first + k.kept.n"))).otherwise(F.col("b.first"))
    return same.select("b.doc_id", "b.sig", start.alias("first"), (F.col("b.first") + F.col("b.n") - start).alias("n"))


def _disjoint(runs: DataFrame) -> DataFrame:
    """(doc_id, sig, gone: sorted, disjoint (first, n)) of runs of lines that may overlap."""
    before = W.partitionBy("doc_id", "sig").orderBy("first", "n").rowsBetween(W.unboundedPreceding, -1)
    begin = F.greatest("first", F.coalesce(F.max(F.col("first") + F.col("n")).over(before), F.lit(0)))
    cut = runs.select("doc_id", "sig", begin.alias("first"), (F.col("first") + F.col("n") - begin).alias("n")).where("n > 0")
    return cut.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("gone"))


def _without(text: Column, gone: Column) -> Column:
    """text less its lines gone: sorted, disjoint (first, n)."""

    def kept(lines: Column) -> Column:
        at = lambda i: F.element_at(gone, i)

        def part(i: Column) -> Column:
            begin = F.when(i > 1, at(F.greatest(i - 1, F.lit(1)))["first"] + at(F.greatest(i - 1, F.lit(1)))["n"]).otherwise(0)
            end = F.when(i <= F.size(gone), at(F.least(i, F.size(gone)))["first"]).otherwise(F.size(lines))
            return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(gone) + 1), part)), "\n")

    return let(F.split(text, "\n", -1), kept)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """docs with text less its repeated chunks and passages, and ``lines_removed``."""
    gone = stored(_disjoint(repeated(docs, key, text, passage_words)), "linededup-gone")
    kept = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("sig"))
    rows = rows.join(gone.hint("merge"), ["doc_id", "sig"], "left")
    old = F.col(f"row.`{text}`")
    new = F.when(F.col("gone").isNull(), old).otherwise(_without(old, F.col("gone")))
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    return rows.select(*(new.alias(text) if c == text else F.col(f"row.`{c}`") for c in kept), removed.alias("lines_removed"))


def op1_linededup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.when(F.col("text").isNotNull(), F.regexp_count("text", F.lit("\n")) + 1).otherwise(0).cast("long")
    return dedup_lines(docs.select("doc_id", "text").withColumn("n_lines", lines)).select("doc_id", "text", "n_lines", "lines_removed")
