"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that, of two fingerprints that differ in at most k
bits, one segment differs in at most one bit: k // 2 + 1 segments. Each segment is indexed
once for each of its bits with that bit wild, equal index keys are joined, and the whole
fingerprints are compared. Equal fingerprints are one node from the start.

Index keys under which many fingerprints meet aren't joined in pairs. There the other half is
indexed too, with one wild bit (or two, where the first halves are equal): all that share such
a key differ in at most two bits, so a link to the least of them keeps every component.

Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows
are kept and share their fingerprint. An empty table gives an empty result. Texts of any length are hashed whole. A bit that just half of
the hashes have is 0. A row without an id keeps its links, but names no component unless all of its rows lack one. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, table
from tallyforge.llm.components import components

HALF = 32
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle of text with A-Z lower-cased; words are cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def majority_bits(hashes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """For each of the 64 bits, lowest first, whether over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts * 2 > len(hashes)


def fingerprint(text: str | None, k: int = 3) -> int:
    """As a signed 64-bit integer."""
    return int(np.packbits(majority_bits(shingle_hashes(text, k)), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) for each row; texts stream through in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, fp long").withColumnRenamed("id", key)


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): a row for each bit of fp. key: that bit's place above, and below it the bit's half of fp with the bit cleared."""
    wild = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("place"))
    return wild.select(_key("fp", "place"), "fp")


def _key(fp: str, place: str) -> Column:
    half = f"(shiftrightunsigned({fp}, {place} - {place} % 32) & 4294967295L)"
    return F.expr(f"shiftleft(CAST({place} AS BIGINT), 32) | ({half} & ~shiftleft(1L, {place} % 32))").alias("key")


def near_links(fps: DataFrame, hot: int = 4096) -> DataFrame:
    """(u, v) for distinct fingerprints fp: links that span the same components as all pairs that differ in 1 or 2 bits.

    hot: more fingerprints than this with the same half (or one bit beside it) are linked through
    keys with two wild bits instead of in pairs; both ways are exact.
    """
    rows = _variants(fps)
    low, high = F.expr("fp & 4294967295L"), F.shiftrightunsigned("fp", HALF)
    halves = fps.select(F.posexplode(F.array(low, high)).alias("seg", "half")).groupBy("seg", "half").count()
    heavy = stored(halves.where(F.col("count") * 2 > hot).select("seg", "half"), "simhash-hot")
    any_hot = not heavy.isEmpty()
    cold = rows.join(_hot_keys(heavy), "key", "left_anti") if any_hot else rows
    # Halves that are equal meet at each of their 32 places and count at the first alone.
    meets = "a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= 2 AND (shiftrightunsigned(a.key, 32) % 32 = 0 OR shiftrightunsigned(a.fp ^ b.fp, CAST(shiftrightunsigned(a.key, 32) AS INT)) & 1 = 1)"
    pairs = cold.alias("a").hint("merge").join(cold.alias("b"), F.expr(f"a.key = b.key AND {meets}")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if any_hot:
        pairs = pairs.unionByName(_hot_links(rows.join(_hot_keys(heavy), "key", "left_semi")))
    return pairs.distinct()


def _hot_keys(heavy: DataFrame) -> DataFrame:
    each = heavy.select(F.expr("shiftleft(half, seg * 32)").alias("fp"), F.explode(F.expr("sequence(seg * 32, seg * 32 + 31)")).alias("place"))
    return each.select(_key("fp", "place")).distinct()


def _hot_links(rows: DataFrame) -> DataFrame:
    rows = rows.select("key", "fp", F.expr("CAST(shiftrightunsigned(key, 32) AS INT)").alias("place")).withColumn("other", F.expr("shiftrightunsigned(fp, 32 - (place - place % 32)) & 4294967295L"))
    bits = F.sequence(F.lit(0), F.lit(HALF - 1))
    one = rows.select("key", "fp", "other", F.explode(bits).alias("p")).select("key", F.expr("other & ~shiftleft(1L, p)").alias("rest"), "p", F.lit(-1).alias("q"), "fp")
    whole = F.expr("shiftleft(CAST(64 + place AS BIGINT), 32) | (shiftrightunsigned(fp, place) & 4294967295L)").alias("key")
    two = rows.where("place % 32 = 0").select(whole, "fp", "other", F.explode(bits).alias("p"))
    two = two.where(f"p < {HALF - 1}").select("*", F.explode(F.sequence(F.col("p") + 1, F.lit(HALF - 1))).alias("q"))
    two = two.select("key", F.expr("other & ~shiftleft(1L, p) & ~shiftleft(1L, q)").alias("rest"), "p", "q", "fp")
    both, key = one.unionByName(two), ["key", "p", "q", "rest"]
    least = both.groupBy(*key).agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u <> top").drop("top")
    return both.join(least, key).where("u <> fp").select("u", F.col("fp").alias("v"))


def op5_simhash(spark, sf_dir: str, hot: int = 4096) -> DataFrame:
    docs = stored(fingerprints(table(spark, sf_dir, "documents")), "simhash-docs")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    label = components(near_links(nodes.select("fp"), hot), "simhash")
    named = nodes.join(label.withColumnsRenamed({"node": "fp", "component": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("component_size"))
    by_fp = named.join(best, "root").select("fp", "component_id", "component_size")
    return docs.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


#: Of the near-duplicate groups below: words of a shingle and least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Texts looked at for frequent shingles, occurrences that make one frequent, and the most that are kept. They set an order: any order gives the same groups.
LOOK, OFTEN, COMMON = 20_000, 8, 20_000
#: Rows of an index key that are joined in one piece, 64-bit words of a set's parity sketch, texts of a key that the others are first compared with, and how many of these.
BLOCK, SKETCH, PIVOTS, NEAREST = 512, 8, 4, 3


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found often in some of the texts, sorted, and their ranks: the more frequent, the higher."""
    part = int(np.ceil(LOOK / max(texts.count(), 1) * 1e6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py(), k)) for t in b.column(0)]
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    counted = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part).select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r.h for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.arange(len(h), 0, -1)[order]


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of a text's distinct shingles, frequent ones last: texts as similar as that share at least one of these."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    n = len(hashes)
    return hashes[np.lexsort((hashes, rank))][: n - int(np.ceil(similarity * n - 1e-6)) + 1]


def sketch(hashes: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """For each of 64 * words buckets whether an odd number of shingles falls in it: sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((hashes >> np.uint64(17)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketch(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set too large for SKETCH words, in as many as give each shingle a bit: a power of two times SKETCH. Empty for other sets."""
    fold = int(np.ceil(np.log2(max(len(hashes), 1) / (64 * SKETCH))))
    return sketch(hashes, SKETCH << fold) if fold > 0 else np.empty(0, np.int64)


def may_be_similar(a: np.ndarray, n: int, b: np.ndarray, m: int, similarity: float) -> bool:
    """Whether sets of n and m shingles can be similar by their wide sketches; the wider is folded onto the other. True where either is empty."""
    if not len(a) or not len(b):
        return True
    while len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count((a ^ b).view(np.uint64)).sum())) * (1 + similarity) >= (n + m) * 2 * similarity - 1e-6


def _prefixes(texts: DataFrame, k: int, similarity: float, prints: bool) -> DataFrame:
    """(id, fp: the text's fingerprint, or 0 where prints aren't wanted, sig: hash of the text's distinct shingles, n: how many, first: their prefix, bits and wide: their sketches)."""
    known = texts.sparkSession.sparkContext.broadcast(_common(texts, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sigs, sizes, first, bits, wide = [], [], [], [], [], []
            for t in b.column(1):
                words = t.as_py()
                h = np.unique(shingle_hashes(words, k))
                fps.append(fingerprint(words) if prints else 0)
                sigs.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
                sizes.append(len(h))
                first.append(prefix(h, similarity, *known.value).view(np.int64))
                bits.append(sketch(h))
                wide.append(wide_sketch(h))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (first, bits, wide)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), *lists], ["id", "fp", "sig", "n", "first", "bits", "wide"])

    return texts.mapInArrow(run, "id long, fp long, sig long, n int, first array<long>, bits array<long>, wide array<long>")


def _index(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, id, n, i: the shingle's place, short: whether the text may be the smaller of a pair here, c: rows of the key) for keys that pairs may meet in."""
    short = (F.col("n") - F.col("i")) * (1 + similarity) >= F.col("n") * (2 * similarity) - 1e-6
    rows = nodes.select("id", "n", F.posexplode("first").alias("i", "key")).select("key", "id", "n", "i", short.alias("short"))
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.col("short").cast("int")).alias("shorts")).where("c > 1 AND shorts > 0")
    return rows.join(keys.select("key", "c"), "key")


def _fits(similarity: float) -> Column:
    """Whether the texts a and b can be similar if this is the first shingle that they share."""
    rest = lambda x: (F.col(f"{x}.n") - F.col(f"{x}.i")) * (1 + similarity) >= (F.col("a.n") + F.col("b.n")) * similarity - 1e-6
    return (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-6) & rest("a") & rest("b")


def _differ() -> Column:
    """Bits in which the sketches of a and b differ."""
    return sum((F.bit_count(F.col(f"a.b{k}").bitwiseXOR(F.col(f"b.b{k}"))) for k in range(1, SKETCH)), F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))))


def _may_be(similarity: float) -> Column:
    """Whether two sets can be similar by their sketches."""
    both = F.col("a.n") + F.col("b.n")
    return (both - _differ()) * (1 + similarity) >= both * (2 * similarity) - 1e-6


def _ordered(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _pivot_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v): each text with the NEAREST, by sketch, of its keys' pivots: PIVOTS texts of each key, by hashes."""
    chosen = [F.max_by(F.struct("id", "n", "i", *_BITS), F.xxhash64("id", F.lit(turn))) for turn in range(PIVOTS)]
    pivots = rows.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("p")).select("key", F.inline("p"))
    met = pivots.alias("a").join(rows.alias("b"), F.expr("a.key = b.key AND a.id <> b.id") & _fits(similarity) & _may_be(similarity))
    near = met.select(F.col("b.id").alias("v"), F.col("a.id").alias("u"), _differ().alias("d")).distinct()
    return _ordered(near.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("d", "u"))).where(f"r <= {NEAREST}"))


def _apart(rows: DataFrame, root: DataFrame) -> DataFrame:
    """rows of the keys whose texts aren't all in one group yet, with each text's group (root) and its key's largest (top)."""
    rows = rows.drop("root", "top").join(root.select(F.col("node").alias("id"), F.col("component").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = rows.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    return rows.join(groups.select("key", F.col("top.root").alias("top")), "key")


_BITS = [f"b{k}" for k in range(SKETCH)]


def _other_pairs(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """(u, v): all pairs of each key that aren't in one group yet and whose sketches don't rule them out.

    Texts of the key's largest group aren't joined with each other. The larger texts of a key are dealt
    into blocks and the smaller ones go to each block, so that no task gets all pairs of a frequent key.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    small = rows.where("short").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.explode(F.when(F.col("root") == F.col("top"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    large = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("side", (F.col("root") == F.col("top")).cast("int"))
    met = F.expr("a.key = b.key AND a.block = b.block AND a.side = b.side AND a.root <> b.root AND (a.n < b.n OR (a.n = b.n AND a.id < b.id))")
    return _ordered(small.alias("a").join(large.alias("b"), met & _fits(similarity) & _may_be(similarity)).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")))


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that wide sketches don't rule out: a small part of long texts' pairs, before whole texts are joined."""
    wide = nodes.where(F.size("wide") > 0).select("id", "n", "wide")
    both = pairs.join(wide.select(F.col("id").alias("u"), F.col("n").alias("n"), F.col("wide").alias("a")), "u", "left").join(wide.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("wide").alias("b")), "v", "left")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            cells = zip(*(c.to_pylist() for c in r.columns[2:4]), *(r.column(k) for k in (4, 5)), strict=True)
            good = [not a.is_valid or not b.is_valid or may_be_similar(a.values.to_numpy(), n, b.values.to_numpy(), m, similarity) for n, m, a, b in cells]
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "n", "m", "a", "b").mapInArrow(keep, "u long, v long")


def jaccard(a: str | None, b: str | None, k: int = SHINGLE) -> float:
    x, y = np.unique(shingle_hashes(a, k)), np.unique(shingle_hashes(b, k))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _similar(pairs: DataFrame, all_texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs (u, v) whose texts' shingles have that Jaccard similarity."""
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    texts = stored(all_texts.join(ids, "id").dropDuplicates(["id"]), "near-texts")
    both = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [jaccard(x.as_py(), y.as_py(), k) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(close, "u long, v long")


def _print_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links of the nodes that span what their fingerprints reach by links of 2 or fewer bits: each with the least of its fingerprint, and the least of two near fingerprints."""
    prints = stored(rows.select("sig", "fp").distinct().join(nodes.select("sig", "id"), "sig").select("id", "fp"), "near-prints")
    least = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "near-least")
    same = prints.join(least, "fp").where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    ends = (least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}")) for c in ("u", "v"))
    near = near_links(least.select("fp")).join(next(ends), "u").join(next(ends), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return same.unionByName(near)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, key: str = "doc_id", text: str = "text", block: int = BLOCK, prints: bool = False) -> DataFrame:
    """(key, group_id: least key of its near-duplicate group) for each row with a key.

    Texts with equal sets of k-word shingles are one node; links are all pairs whose sets have that
    Jaccard similarity, at every size of the table. Similar texts share a shingle of their prefixes.
    First each text is compared with a few others, those nearest by sketch of some that stand for its shingles' texts, which
    joins large groups. Then all pairs that share a shingle and aren't in one group yet are compared, less those whose sketches show that they differ in too many
    shingles (a bound, not an estimate; long texts' sketches have a bit for each shingle). Every link is verified by the texts.
    prints: before all that, texts are linked by their fingerprints as op 5 does it, and these links stay; the comparisons then add
    what differs in more bits.

    Null texts and texts without words have no shingles and are one group; a text of fewer words than k is one shingle. Texts of any length are
    looked at whole. Repeated rows come out as often as they went in. Rows without a key are left out. An empty table gives
    an empty result. Other columns, whatever their names, aren't looked at.
    """
    texts = _texts(docs.where(F.col(key).isNotNull()), key, text)
    rows = stored(_prefixes(texts, k, similarity, prints), "near-rows")
    nodes = stored(rows.groupBy("sig").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("first").alias("first"), F.min("bits").alias("bits"), F.min("wide").alias("wide")), "near-nodes")
    index = _index(nodes, similarity)
    sketches = nodes.select("id", *(F.col("bits")[i].alias(c) for i, c in enumerate(_BITS)))
    rows_by_key = stored(index.join(sketches, "id"), "near-index")
    links = stored(_similar(stored(_plausible(_pivot_pairs(rows_by_key, similarity), nodes, similarity), "near-pivots"), texts, similarity, k), "near-links")
    if prints:
        links = links.unionByName(stored(_print_links(rows, nodes), "near-print-links"))
    apart = stored(_apart(rows_by_key, components(links, "near-groups")), "near-apart")
    others = stored(_plausible(_other_pairs(apart, similarity, block), nodes, similarity), "near-others")
    label = components(links.unionByName(_similar(others, texts, similarity, k)), "near").withColumnsRenamed({"node": "n", "component": "c"})
    named = nodes.select("sig", F.col("id").alias("n")).join(label, "n", "left").select("sig", F.coalesce("c", "n").alias("group_id"))
    return rows.select("id", "sig").join(named, "sig").select(F.col("id").alias(key), "group_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less all but the least-keyed document of each near-duplicate group, linked by fingerprints, then by texts.

    Rows without a key stay, and so do all rows of a document that stays; of documents without words one stays. All columns pass through.
    """
    mark = "_" + max(docs.columns, key=len)  # no column of docs has so long a name
    kept = near_groups(docs, key=key, text=text, prints=True).where(F.col(key) == F.col("group_id")).select(F.col(key).alias(mark)).distinct()
    return docs.join(kept, F.col(key).cast("long") == F.col(mark), "left").where(F.col(mark).isNotNull() | F.col(key).isNull()).drop(mark)
