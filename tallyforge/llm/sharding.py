"""Rows into shards of near equal bytes by sampled splitters, in DataFrame functions alone.

A row's size is its text's bytes plus ROW_BYTES. Keys are hashes of texts, so that equal texts lie in one range.
Keys are drawn with a chance in proportion to their rows' sizes; quantiles of these draws bound OVER ranges for each
shard, and a key that would fill a range gets one of its own. All rows are then counted by range. A range that is over
FULL times its share is subdivided: by text, where it holds only one text by id, and where it holds only one id by place.
Ranges are dealt to shards by their counted bytes, the largest first, each to the least filled shard.

The driver holds the draws (SAMPLE for each range, about) and the ranges' counts, both bounded by parameters; all
rows are counted and placed. Rows get slots by numbering within buckets of about BUCKET rows and adding what lies before a bucket.

Null text has no bytes. Null ids are one value. Texts of any length are one row each: a shard is over its share by at most
the largest piece that can't be divided, a row. Repeated rows each get a slot; they are told apart by their place in the
stored digests alone. An empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import let, stored, table

SHARDS, ROW_BYTES, OVER, SAMPLE, FULL, ROUNDS, BUCKET = 24, 8, 64, 16, 4, 8, 1 << 17
TEXT, ID, PLACE = range(3)


def literal(values: list[int]) -> Column:
    """A constant array, folded into one literal when the query is planned."""
    return F.expr(f"cast(split('{','.join(map(str, values or [0]))}', ',') AS array<bigint>)")


def at(values: list[int], place: Column) -> Column:
    return F.get(literal(values), place.cast("int"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A narrow row for each document: all that sharding looks at."""
    content = F.col(text).cast("string")
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(content), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(content).alias("_text"), F.xxhash64(F.col(key).cast("long")).alias("_id"),
        F.monotonically_increasing_id().alias("_place"),
    )


@dataclass
class Splitters:
    """bounds: the keys at which ranges after the first begin. cuts: for each round of subdivision (first new unit, pieces, by what) of each unit."""

    bounds: list[int]
    cuts: list[tuple[list[int], list[int], list[int]]] = field(default_factory=list)
    shards: list[int] = field(default_factory=list)

    def unit(self) -> Column:
        """The number of a digest's last range."""
        steps = [1 << i for i in reversed(range(len(self.bounds).bit_length()))] or [1]
        key, one = F.col("_text"), F.lit(1)
        begun = lambda i: F.coalesce(at(self.bounds, i - one) <= key, F.lit(False)) if self.bounds else F.lit(False)
        found = F.aggregate(literal(steps), F.lit(0).cast("long"), lambda low, step: F.when(begun(low + step), low + step).otherwise(low))
        for k in range(len(self.cuts)):
            found = let(found, partial(self._piece, k))
        return found

    def _piece(self, k: int, unit: Column) -> Column:
        first, pieces, by = self.cuts[k]
        what, salt = at(by, unit), F.lit(k)
        h = F.when(what == TEXT, F.xxhash64("_text", salt)).when(what == ID, F.xxhash64("_id", salt)).otherwise(F.xxhash64("_place", salt))
        return at(first, unit) + F.pmod(h, at(pieces, unit))

    def shard(self, unit: Column) -> Column:
        return at(self.shards, unit).cast("int")


def quantiles(draws: list[tuple[int, int]], ranges: int) -> list[int]:
    """Bounds from (key, draws) in order of key: about equal draws in each range, and each key that fills a range alone."""
    share, out, held = sum(n for _, n in draws) / ranges, [], 0
    for key, n in draws:
        if n >= share:
            out += [key, key + 1]
            held = 0
        elif (held := held + n) >= share:
            out.append(key + 1)
            held = 0
    return sorted({b for b in out if b < 1 << 63})


def counted(rows: DataFrame, splitters: Splitters) -> list:
    found = rows.groupBy(splitters.unit().alias("unit")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("_text") != F.max("_text")).alias("texts"), (F.min("_id") != F.max("_id")).alias("ids")
    )
    return found.orderBy("unit").collect()  # a row for each range, bounded by OVER, SAMPLE and the shards


def dealt(units: list, shards: int) -> dict[int, int]:
    """A shard for each unit: the largest first, each to the least filled."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for u in sorted(units, key=lambda u: (-u.bytes, u.unit)):
        filled, s = heapq.heappop(load)
        out[u.unit] = s
        heapq.heappush(load, (filled + u.bytes, s))
    return out


def sample_splitters(rows: DataFrame, shards: int, over: int = OVER, sample: int = SAMPLE) -> Splitters:
    """Of digests()."""
    ranges = shards * over
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return Splitters([], shards=[0])
    chance = F.pmod(F.xxhash64("_text", "_id", F.lit("draw")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    draws = F.floor(F.col("size") * F.lit(ranges * sample / total) + chance)
    drawn = rows.select("_text", draws.alias("n")).where("n > 0").groupBy("_text").agg(F.sum("n").alias("n")).orderBy("_text").collect()
    out = Splitters(quantiles([(r[0], int(r[1])) for r in drawn], ranges))
    most = total / ranges
    units = counted(rows, out)
    for _ in range(ROUNDS):
        if not any(u.bytes > FULL * most and u.n > 1 for u in units):
            break
        known, first, pieces, by, new = {u.unit: u for u in units}, [], [], [], 0
        for i in range(max(known) + 1):
            u = known.get(i)
            over_full = u is not None and u.bytes > FULL * most and u.n > 1
            first.append(new)
            pieces.append(min(u.n, -int(-u.bytes // most)) if over_full else 1)
            by.append((TEXT if u.texts else ID if u.ids else PLACE) if over_full else TEXT)
            new += pieces[-1]
        out.cuts.append((first, pieces, by))
        units = counted(rows, out)
    places = dealt(units, shards)
    out.shards = [places.get(i, 0) for i in range(max(places) + 1)]
    return out


def slots(rows: DataFrame, splitters: Splitters, bucket: int = BUCKET) -> DataFrame:
    """rows with ``shard`` and a gapless ``slot`` in it, from 0."""
    rows = rows.withColumn("_unit", splitters.unit()).withColumn("shard", splitters.shard(F.col("_unit")))
    sizes = rows.groupBy("shard", "_unit").agg(F.count("*").alias("_n")).withColumn("_buckets", F.ceil(F.col("_n") / bucket))
    many = sizes.select(F.col("_unit").alias("_u"), "_buckets")
    rows = rows.join(F.broadcast(many), F.col("_unit") == F.col("_u")).drop("_u")  # a row for each range, as in counted()
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_id", F.when(F.col("_buckets") > 1, F.col("_place"))), F.col("_buckets")))
    held = rows.groupBy("shard", "_unit", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_unit", "_bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    starts = held.select(F.col("_unit").alias("_u"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_unit", "_bucket").orderBy("_text", "doc_id", "text_crc32", "size", "_place"))
    placed = rows.withColumn("_row", inside).join(starts, (F.col("_unit") == F.col("_u")) & (F.col("_bucket") == F.col("_b")))
    return placed.withColumn("slot", F.col("_start") + F.col("_row") - 1)


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", over: int = OVER, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row."""
    rows = stored(digests(docs, key, text), "sharding-digests")
    return slots(rows, sample_splitters(rows, shards, over), bucket).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """docs as Parquet below path, a folder for each shard; a task writes one range's rows, so that no shard goes through one task."""
    splitters = sample_splitters(stored(digests(docs, key, text), "sharding-digests"), shards)
    names = {"_text": F.xxhash64(F.col(text).cast("string")), "_id": F.xxhash64(F.col(key).cast("long")), "_place": F.monotonically_increasing_id()}
    kept = [c for c in docs.columns if c not in {*names, "_unit", "shard"}]
    rows = docs.select(*kept, *(c.alias(n) for n, c in names.items())).withColumn("_unit", splitters.unit()).withColumn("shard", splitters.shard(F.col("_unit")))
    rows.repartition("_unit").select(*kept, "shard").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    got = sharded(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
