"""Benchmark decontamination over a distributed positional inverted index.

A test item's windows are its runs of WINDOW words (an item of fewer words is one window). The
terms of all items are counted over the whole corpus; each window is anchored at its rarest
terms. For these terms, postings (term, document, position) of the corpus are stored.
Subtracting a term's place in the item from its positions gives offset-adjusted lists; a
window occurs only where the lists of all its anchors meet, and there the document's words are
compared with the window's. Anchors that meet within a few places of each other, but not in
the phrase itself, give proximity matches.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. Null and empty texts have no
words; items without words have no windows. Texts of any length are indexed whole. Each row of a document has its own
result, also where rows share an id; rows equal in id and text have equal ones. Rows without an id have no hits. Repeated items match each by itself; what an item without an
id hits is counted, but the item isn't listed. Terms of equal rarity (ties) are taken in order of place. Columns other than id and text
aren't looked at. Empty tables give no matches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import ascii_lower, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, ANCHORS, SLOP = 10, 2, 3
#: Documents indexed at a time in a task.
PART = 500
#: Tables of at most so many rows and bytes, as JSON, are broadcast to the corpus; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _is_small(df: DataFrame) -> bool:
    size = df.select(F.length(F.to_json(F.struct("*"))).alias("b")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum("b")).first()
    return size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _is_small(df) else df


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, row: a number for each row of items with words, n, q, term): one row for each word."""
    rows = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0").withColumn("row", F.xxhash64("item", "w"))
    return rows.dropDuplicates(["row"]).select("item", "row", F.size("w").alias("n"), F.posexplode("w").alias("q", "term"))


_FOLD, _WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), re.compile(rb"[0-9a-z\x80-\xff]+")


def split_words(text: str | None) -> list[bytes]:
    """As words(), in UTF-8 bytes: for passes over all texts, where it takes a fraction of the time."""
    return _WORD_BYTES.findall((text or "").encode().translate(_FOLD))


def _kept(terms: DataFrame):
    """A broadcast set of the terms if they are few; else None: all words pass and a join drops the others."""
    found = terms.select("term").distinct()
    return terms.sparkSession.sparkContext.broadcast({r.term.encode() for r in found.collect()}) if _is_small(found) else None


def corpus_terms(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, occurrences) for the given terms over all documents; counted in each task before the shuffle."""
    kept = _kept(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0):
                words = split_words(t.as_py())
                n.update(words if kept is None else filter(kept.value.__contains__, words))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("occurrences"))
    return counted.join(_small(terms.select("term").distinct()), "term")


def anchors(terms: DataFrame, counts: DataFrame, window: int = WINDOW, k: int = ANCHORS) -> DataFrame:
    """(row, qs: sorted places of a window's k rarest terms, their terms, starts: the windows of row with these anchors).

    Windows with a term that the corpus lacks have no anchors: they occur nowhere.
    """
    known = terms.join(counts, "term", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - window + 1), F.least("q", F.greatest(F.lit(0), F.col("n") - window)))
    each = known.select("row", "q", "term", "occurrences", F.explode(starts).alias("s"))
    ranked = each.groupBy("row", "s").agg(F.sort_array(F.collect_list(F.struct("occurrences", "q", "term"))).alias("w"))  # window terms at most
    kept = ranked.where(F.col("w")[0]["occurrences"].isNotNull()).select("row", "s", F.array_sort(F.transform(F.slice("w", 1, k), lambda x: F.struct(x["q"].alias("q"), x["term"].alias("term")))).alias("a"))
    return kept.groupBy("row", "a").agg(F.sort_array(F.collect_list("s")).alias("starts")).select("row", F.col("a.q").alias("qs"), F.col("a.term").alias("terms"), "starts")


def postings(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of the given terms, stored by document: (doc_id, sig: hash of the text, n_words, found: array of (term, p))."""
    kept = _kept(terms)

    def index(part: pa.RecordBatch) -> pa.RecordBatch:
        found, places, ends, n = [], [], [0], []
        for t in part.column(2):
            words = split_words(t.as_py())
            mine = [(w, p) for p, w in enumerate(words) if kept is None or w in kept.value]
            found += [w for w, _ in mine]
            places += [p for _, p in mine]
            ends.append(len(found))
            n.append(len(words))
        pairs = pa.StructArray.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(places, pa.int32())], ["term", "p"])
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "sig", "n_words", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PART):
                yield index(b.slice(start, PART))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _sig(text).alias("sig"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, sig long, n_words long, found array<struct<term:string,p:int>>"), "postings")


def _sig(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, sig, p) with the columns of terms."""
    return index.where("size(found) > 0").select("doc_id", "sig", F.inline("found")).join(_small(terms), "term")


def shifted(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """Offset-adjusted lists: (row, qs, doc_id, sig, shift: where row would begin, bit: which of the anchors qs is there)."""
    each = anchored.select("row", "qs", F.posexplode(F.arrays_zip("qs", "terms")).alias("i", "a")).select("row", "qs", F.col("a.qs").alias("q"), F.col("a.terms").alias("term"), F.expr("shiftleft(1, i)").alias("bit"))
    return _postings(index, each).select("row", "qs", "doc_id", "sig", (F.col("p") - F.col("q")).alias("shift"), "bit")


def _all_met() -> Column:
    return F.bit_or("bit") == F.expr("shiftleft(1, size(qs)) - 1")


def candidates(lists: DataFrame, anchored: DataFrame) -> DataFrame:
    """(row, s, doc_id, sig, d): places d of documents where all anchors of the window s of row meet."""
    met = lists.groupBy("row", "qs", "doc_id", "sig", "shift").agg(_all_met().alias("all")).where("all").drop("all")
    fits = met.join(_small(anchored.select("row", "qs", "starts")), ["row", "qs"])
    return fits.select("row", F.explode("starts").alias("s"), "doc_id", "sig", "shift").select("row", "s", "doc_id", "sig", (F.col("shift") + F.col("s")).alias("d")).where("d >= 0")


def proximity(lists: DataFrame, slop: int = SLOP) -> DataFrame:
    """(row, doc_id, sig) where all anchors of a window of row lie within slop places of where its phrase would have them."""
    following = W.partitionBy("row", "qs", "doc_id", "sig").orderBy("shift").rangeBetween(0, slop)
    met = F.bit_or("bit").over(following) == F.expr("shiftleft(1, size(qs)) - 1")
    return lists.select("row", "doc_id", "sig", met.alias("all")).where("all").select("row", "doc_id", "sig").distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: (doc_id, sig: hash of its text, n_words, n_hit, items: those with windows that occur, sorted as strings, near_items: those with proximity matches)."""
    terms = stored(item_words(items, item_key, item_text), "test-terms")
    anchored = stored(anchors(terms, corpus_terms(docs, terms, text), window), "test-anchors")
    index = postings(docs, anchored.select(F.explode("terms").alias("term")), key, text)
    lists = stored(shifted(index, anchored), "test-lists")
    owners = _small(terms.select("row", "item").distinct())
    length = F.least(F.lit(window), F.col("n"))
    ranges = terms.groupBy("row").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("q", "term"))), lambda x: x["term"]).alias("w"))
    phrases = ranges.select("row", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("s")).select("row", "s", "length", F.slice("w", F.col("s") + 1, F.col("length")).alias("phrase"))
    places = stored(candidates(lists, anchored).join(terms.select("row", "n").distinct(), "row").select("row", "s", "doc_id", "sig", "d", length.alias("length")), "decontamination-candidates")
    # The words of documents that have candidates decide; if these are few, no text is shuffled. A document brings no more than places of its own words.
    ids = ["doc_id", "sig"]
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), _sig(text).alias("sig"), F.col(text).alias("_text")).join(_small(places.select(*ids).distinct()), ids, "left_semi")
    per_doc = places.groupBy(*ids).agg(F.collect_set(F.struct("row", "s", "d", "length")).alias("c"))
    at = whole.join(per_doc, ids).select(*ids, "c", words(F.col("_text")).alias("w")).select(*ids, "w", F.inline("c"))  # words are found once a document
    exact = at.select(*ids, "row", "s", "d", F.slice("w", F.col("d") + 1, F.col("length")).alias("phrase")).join(_small(phrases), ["row", "s", "phrase"])
    exact = stored(exact.select(*ids, "row", "d", "length"), "decontamination-exact")
    hits = exact.select(*ids, F.explode(F.sequence(F.col("d"), F.col("d") + F.col("length") - 1)).alias("p")).distinct().groupBy(*ids).agg(F.count("*").alias("n_hit"))

    def named(found: DataFrame, name: str) -> DataFrame:
        return found.select(*ids, "row").distinct().join(owners, "row").select(*ids, F.col("item").cast("string").alias("item")).distinct().groupBy(*ids).agg(F.array_sort(F.collect_list("item")).alias(name))

    found = hits.join(named(exact, "items"), ids, "left").join(named(proximity(lists), "near_items"), ids, "full_outer").withColumnsRenamed({"doc_id": "_doc", "sig": "_of"})
    none = F.array().cast("array<string>")
    rows = index.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("sig") == F.col("_of")), "left")
    return rows.select("doc_id", "sig", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = contaminated(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )
