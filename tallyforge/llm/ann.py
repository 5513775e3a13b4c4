"""Nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample (SAMPLE vectors, by a hash) at the median along the difference of two of
its points, again and again; the planes are broadcast, and every vector is filed under its
leaf of each tree. A query goes down all trees at once through one priority queue, whose
priority is the least margin by which it was on a branch's side so far, until it has taken a
share of all leaves. Leaves and the queries that take them meet by a shuffle, leaf by leaf; there distances are
exact, in double precision, on the original vectors, and each query's nearest go on.

Equal vectors are one node with its KEEP smallest ids: no more of them can be among a
query's K nearest, so this loses nothing. Leaves that hold over BLOCK vectors are split into blocks,
each of which meets the leaf's queries.

Left out: vectors that are null, zero, hold null or non-finite components, or have another
length than most. Rows without an id are left out as well. Ties go to the smaller id. A repeated id
counts once, with the least of its vectors where it has several, as candidate and as query. An empty
table gives an empty result; fewer than K candidates are all returned.

SHARE fits data without any structure (points spread evenly on a sphere), where recall needs
many leaves; data with near neighbours does with far fewer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import stored, table

K, KEEP = 10, 11
TREES, LEAF, SAMPLE, SHARE, BLOCK = 16, 1024, 8192, 0.075, 2048
LEAST_SAMPLED = 8  # sampled vectors to a leaf, at least


@dataclass
class Forest:
    normals: np.ndarray  # trees x (2**depth - 1) x dimensions; node i has the children 2i + 1 and 2i + 2
    offsets: np.ndarray  # trees x (2**depth - 1)
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 5) -> Forest:
        r = np.random.default_rng(seed)
        n, dim = 2**depth - 1, sample.shape[1] if sample.ndim == 2 else 0
        out = cls(np.zeros((trees, n, dim)), np.zeros((trees, n)), depth)
        for t in range(trees):
            inside = {0: sample}
            for i in range(n):
                points = inside.pop(i)
                normal = r.standard_normal(dim)
                if len(points) > 1:
                    a, b = points[r.choice(len(points), 2, replace=False)]
                    normal = a - b if (a != b).any() else normal
                normal = normal / np.linalg.norm(normal)
                side = points @ normal
                offset = float(np.median(side)) if len(side) else 0.0
                out.normals[t, i], out.offsets[t, i] = normal, offset
                if 2 * i + 1 < n:
                    inside |= {2 * i + 1: points[side <= offset], 2 * i + 2: points[side > offset]}
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree, from 0."""
        out = np.zeros((len(x), len(self.normals)), np.int32)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The first (tree, leaf) pairs that the shared queue gives, as many as asked for."""
        inner = 2**self.depth - 1
        margins = np.einsum("tnd,d->tn", self.normals, q) - self.offsets
        queue = [(-np.inf, t, 0) for t in range(len(self.normals))]
        out: list[tuple[int, int]] = []
        while queue and len(out) < leaves:
            priority, t, node = heapq.heappop(queue)
            while node < inner:
                m = margins[t, node]
                heapq.heappush(queue, (max(priority, abs(m)), t, 2 * node + 1 + int(m <= 0)))
                node = 2 * node + 1 + int(m > 0)
            out.append((t, node - inner))
        return out


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): each id's vector, the least of those that can be searched."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes.n if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"))


def classes(rows: DataFrame) -> DataFrame:
    """(vid, v, ids) of usable(): each distinct vector, its smallest id, and its KEEP smallest ids in order."""
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(f"r <= {KEEP}")
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "v", "ids")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def nearest_in_block(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Each query's KEEP nearest of own by exact distance, ties to the smaller vid."""
    if own.empty or queries.empty:
        return pd.DataFrame({"qid": [], "vid": [], "d": []})
    own = own.sort_values("vid")
    x, q, vid = _matrix(own["v"]), _matrix(queries["v"]), own["vid"].to_numpy()
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    near = qq[:, None] + xx[None] - 2 * q @ x.T  # its rounding error grows with the norms
    out = []
    for i, qid in enumerate(queries["qid"]):
        row = near[i]
        if len(row) > KEEP:
            cut = np.partition(row, KEEP - 1)[KEEP - 1]
            some = np.flatnonzero(row <= cut + 1e-11 * (2 * qq[i] + xx + xx.max()))
        else:
            some = np.arange(len(row))
        d = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
        best = np.lexsort((vid[some], d))[:KEEP]
        out.append((np.full(len(best), qid), vid[some][best], d[best]))
    return pd.DataFrame(dict(zip(("qid", "vid", "d"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def search(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:  # noqa: ANN001
    """(query_id, rank, vec_id, score) for the rows whose id satisfies the Column is_query, against all other rows."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "ann-rows")
    nodes = stored(classes(rows), "ann-classes")
    n = nodes.count()
    sample = _matrix(pd.Series([r.v for r in nodes.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("v").collect()]))
    depth = int(max(0, min(np.ceil(np.log2(max(n, 1) / LEAF)), np.log2(max(len(sample), 1) / LEAST_SAMPLED))))
    forest = spark.sparkContext.broadcast(Forest.fit(sample, depth))
    leaves = max(TREES, round(share * TREES * 2**depth))

    def filed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = forest.value.leaves(_matrix(p["v"])) if len(p) else np.zeros((0, TREES), np.int32)
            yield pd.DataFrame({"vid": p["vid"], "leaves": list(at)})

    def asked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [forest.value.search(q, leaves) for q in _matrix(p["v"])]
            yield pd.DataFrame({"qid": p["vid"], "v": p["v"], "at": [[t << 20 | x for t, x in f] for f in found]})

    index = stored(nodes.select("vid", "v").mapInPandas(filed, "vid long, leaves array<int>"), "ann-index")
    cell = F.expr("transform(leaves, (x, t) -> shiftleft(t, 20) | x)")
    big = {r.cell: -(-r["count"] // BLOCK) for r in index.select(F.explode(cell).alias("cell")).groupBy("cell").count().where(f"count > {BLOCK}").collect()}  # at most a row for each leaf
    blocks = F.create_map(*(F.lit(x) for pair in big.items() for x in pair)) if big else None
    parts = (lambda c: F.coalesce(blocks[c], F.lit(1))) if big else (lambda c: F.lit(1))
    mine = nodes.select("vid", "v").join(index, "vid").select("vid", "v", F.explode(cell).alias("cell"))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("vid"), parts(F.col("cell")).cast("long")).cast("int"))
    asking = rows.withColumnRenamed("id", key).where(is_query).select(F.col(key).alias("query_id"), "v")
    query_ids = asking.join(nodes.select("vid", "v"), "v").select("query_id", F.col("vid").alias("qid"))
    query_ids = stored(query_ids, "ann-queries")
    wanted = nodes.select("vid", "v").join(query_ids.select(F.col("qid").alias("vid")).distinct(), "vid").mapInPandas(asked, "qid long, v array<float>, at array<int>")
    wanted = wanted.select("qid", "v", F.explode("at").alias("cell")).select("qid", "v", "cell", F.explode(F.sequence(F.lit(0), parts(F.col("cell")) - 1)).alias("block"))
    found = mine.groupBy("cell", "block").cogroup(wanted.groupBy("cell", "block")).applyInPandas(nearest_in_block, "qid long, vid long, d double")
    best = found.groupBy("qid", "vid").agg(F.min("d").alias("d"))
    top = best.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("d", "vid"))).where(f"r <= {k + 1}")
    near = top.join(nodes.select("vid", "ids"), "vid").groupBy("qid").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))))).alias("near"))
    own = query_ids.join(near, "qid").select("query_id", F.slice(F.sort_array(F.filter("near", lambda x: x["id"] != F.col("query_id"))), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))


def op9_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
