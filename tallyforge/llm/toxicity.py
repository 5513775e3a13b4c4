"""Convolutional toxicity classifier over hashed word embeddings.

A word's vector is the sum of a row for its hash and one for its first letters' hash. Filters
of several widths run over the words; each filter's maximum over the whole text feeds one
output. The net is trained in numpy, on the driver, on a bounded sample of labelled documents
(MOST_LABELLED of each label, by a hash of their ids, less those of over MOST_CHARS characters, so that it is 262 MB at the very most) that arrives as hashed words. A fifth of
the sample is held back: on it a threshold is set for each language, as guessed from the words
(naive Bayes over first letters, learned from the same sample), and scores are moved so that
the threshold of each language lies at CUT.

Null and empty texts have no words; they score as a text without any evidence. Texts of any
length are scored whole, in blocks that give the same score as one piece. Repeated rows score alike; rows with equal hashes of
their ids (ties) are taken in order of id. Other columns pass through, but one with the score's name is replaced. With under LEAST_LABELLED rows of either label in
the sample every score is zero. Languages of fewer than LEAST_CALIBRATED held-back positives take the threshold
of all languages.
"""

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import BATCH as PIECE
from tallyforge.llm.common import table

WORD_BITS, PREFIX_BITS, PREFIX = 16, 14, 4
WIDTHS, FILTERS, DIM = (1, 2, 3), 12, 16
PAD = max(WIDTHS)  # empty places after a document: windows that begin in it, or right after it, reach into no other
MOST_LABELLED, MOST_CHARS, LEAST_LABELLED, CUT, LEAST_CALIBRATED = 4000, 16_384, 10, 0.3, 20
EPOCHS, BATCH, RATE, BLOCK = 6, 32, 0.05, 1 << 15
_WORDS, _KEPT = re.compile(r"\w+"), 200_000
_CACHE: dict[str, int] = {}


def features(text: str | None) -> np.ndarray:
    """For each word of text its two buckets in one integer."""
    words = _WORDS.findall((text or "").lower())
    found = list(map(_CACHE.get, words))
    if None in found:
        if len(_CACHE) > _KEPT:
            _CACHE.clear()
        for i, (w, x) in enumerate(zip(words, found, strict=True)):
            if x is None:
                b = w.encode("utf-8", "surrogatepass")
                found[i] = (zlib.crc32(b) & (1 << WORD_BITS) - 1) << PREFIX_BITS | zlib.crc32(w[:PREFIX].encode("utf-8", "surrogatepass"), 7) & (1 << PREFIX_BITS) - 1
                if len(w) < 40:
                    _CACHE[w] = found[i]
    return np.array(found, np.int32)


@dataclass
class Net:
    words: np.ndarray
    prefixes: np.ndarray
    filters: np.ndarray  # DIM x (sum of WIDTHS) * FILTERS, a block of columns for each place of each width
    shift: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    languages: list[str] = field(default_factory=list)
    priors: np.ndarray | None = None  # PREFIX_BITS buckets x languages, log probabilities
    thresholds: np.ndarray | None = None  # on the raw output, by language; the last for none
    trained: bool = False

    @classmethod
    def fresh(cls, seed: int = 7) -> "Net":
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        return cls(f(1 << WORD_BITS, DIM, k=0.05), f(1 << PREFIX_BITS, DIM, k=0.05), f(DIM, sum(WIDTHS) * FILTERS, k=0.3), np.zeros(len(WIDTHS) * FILTERS, np.float32), f(len(WIDTHS) * FILTERS, k=0.2))

    def vectors(self, x: np.ndarray) -> np.ndarray:
        return self.words[x >> PREFIX_BITS] + self.prefixes[x & (1 << PREFIX_BITS) - 1]

    def responses(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each filter at each place (rows of docs one after another, each followed by PAD empty places), and where docs start."""
        sizes = np.array([len(d) + PAD for d in docs])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        x = np.zeros((int(sizes.sum()) + PAD, DIM), np.float32)
        for s, d in zip(starts.tolist(), docs, strict=True):
            x[s : s + len(d)] = self.vectors(d)
        y, parts, at = x @ self.filters, [], 0
        n = len(x) - PAD
        for w in WIDTHS:
            z = y[:n, at * FILTERS : (at + 1) * FILTERS].copy()
            for o in range(1, w):
                z += y[o : n + o, (at + o) * FILTERS : (at + o + 1) * FILTERS]
            parts.append(z)
            at += w
        return np.hstack(parts), starts, sizes, x

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        """The output for each document before any threshold; whole documents, in blocks of about BLOCK words."""
        pending: list[tuple[int, np.ndarray, int]] = []  # document, words, places whose windows count
        tops = np.full((len(docs), len(self.out)), -np.inf, np.float32)

        def flush() -> None:
            if pending:
                z, starts, _, _ = self.responses([d for _, d, _ in pending])
                for (i, _, places), at in zip(pending, starts.tolist(), strict=True):
                    np.maximum(tops[i], z[at : at + places].max(axis=0), out=tops[i])
                pending.clear()

        held = 0
        for i, d in enumerate(docs):
            for s in range(0, max(len(d), 1), BLOCK):
                # a block carries the words that its last windows reach into; windows that begin in those belong to the next block
                last = s + BLOCK >= len(d)
                part = d[s : s + BLOCK + PAD - 1]
                pending.append((i, part, len(part) + 1 if last else BLOCK))
                held += len(part)
                if held >= BLOCK:
                    flush()
                    held = 0
        flush()
        return np.maximum(tops + self.shift, 0) @ self.out + self.bias

    def language(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.priors is None:
            return np.zeros(len(docs), np.int64)
        none = self.priors.shape[1]
        return np.array([int(self.priors[d & (1 << PREFIX_BITS) - 1].sum(axis=0).argmax()) if len(d) else none for d in docs])

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        if not self.trained or not docs:
            return np.zeros(len(docs))
        z = self.raw(docs) - self.thresholds[self.language(docs)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) + np.log(CUT / (1 - CUT)), -40, 40)))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adagrad on the logistic loss, labels weighted to count alike. Only places where a filter has its maximum get gradients."""
        r = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6)).astype(np.float32)
        squares = {k: np.full_like(getattr(self, k), 1e-4) for k in ("words", "prefixes", "filters", "shift", "out")}
        square_bias = 1e-4
        column = np.concatenate([np.full(FILTERS, sum(WIDTHS[:i])) for i in range(len(WIDTHS))])  # first column block of each filter
        width = np.repeat(WIDTHS, FILTERS)
        k = np.arange(len(self.out))
        for _ in range(EPOCHS):
            order = r.permutation(len(docs))
            for begin in range(0, len(order), BATCH):
                some = order[begin : begin + BATCH]
                z, starts, sizes, x = self.responses([docs[i] for i in some])
                best = np.stack([s + z[s : s + n - PAD + 1].argmax(axis=0) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
                top = np.take_along_axis(z, best.reshape(-1, len(k)), axis=0) + self.shift
                pooled = np.maximum(top, 0)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))
                g = (p - labels[some]) * weight[some] / len(some)
                back = g[:, None] * self.out * (top > 0)
                grad_filters = np.zeros_like(self.filters)
                rows, deltas = [], []
                for o in range(max(WIDTHS)):
                    use = k[width > o]
                    at = best[:, use] + o
                    cols = (column[use] + o) * FILTERS + use % FILTERS
                    vec = x[np.minimum(at, len(x) - 1)]  # documents x filters x DIM
                    np.add.at(grad_filters.T, np.broadcast_to(cols, at.shape).ravel(), (vec * back[:, use, None]).reshape(-1, DIM))
                    rows.append(at.ravel())
                    deltas.append((back[:, use, None] * self.filters[:, cols].T).reshape(-1, DIM))
                self._step("filters", grad_filters, squares)
                self._step("shift", back.sum(axis=0), squares)
                self._step("out", g @ pooled + 1e-4 * self.out, squares)
                square_bias += float(g.sum()) ** 2
                self.bias -= RATE * float(g.sum()) / square_bias**0.5
                self._step_rows(np.concatenate(rows), np.concatenate(deltas), [docs[i] for i in some], starts, squares)

    def _step(self, name: str, g: np.ndarray, squares: dict) -> None:
        squares[name] += g * g
        setattr(self, name, getattr(self, name) - RATE * g / np.sqrt(squares[name]))

    def _step_rows(self, places: np.ndarray, deltas: np.ndarray, docs: list, starts: np.ndarray, squares: dict) -> None:
        ids = np.full(int(starts[-1]) + len(docs[-1]) + 2 * PAD, -1, np.int64)
        for s, d in zip(starts.tolist(), docs, strict=True):
            ids[s : s + len(d)] = d
        x = ids[np.minimum(places, len(ids) - 1)]
        real = (x >= 0) & (deltas != 0).any(axis=1)
        for name, rows in (("words", x[real] >> PREFIX_BITS), ("prefixes", x[real] & (1 << PREFIX_BITS) - 1)):
            unique, where = np.unique(rows, return_inverse=True)
            g = np.zeros((len(unique), DIM), np.float32)
            np.add.at(g, where, deltas[real])
            squares[name][unique] += g * g
            getattr(self, name)[unique] -= RATE * g / np.sqrt(squares[name][unique])

    def learn_languages(self, docs: list[np.ndarray], names: list[str | None]) -> None:
        self.languages = sorted({n for n in names if n is not None})
        if not self.languages:
            return
        counts = np.ones((1 << PREFIX_BITS, len(self.languages)))
        for d, n in zip(docs, names, strict=True):
            if n is not None:
                np.add.at(counts[:, self.languages.index(n)], d & (1 << PREFIX_BITS) - 1, 1)
        self.priors = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def calibrate(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        z, lang = self.raw(docs), self.language(docs)
        whole = best_threshold(z, labels)
        n = len(self.languages)
        enough = [(labels[lang == i] == 1).sum() >= LEAST_CALIBRATED and (labels[lang == i] == 0).sum() >= LEAST_CALIBRATED for i in range(n)]
        self.thresholds = np.array([best_threshold(z[lang == i], labels[lang == i]) if enough[i] else whole for i in range(n)] + [whole])


def best_threshold(z: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap between outputs that gives the best F1."""
    order = np.argsort(z)
    z, y = z[order], labels[order]
    caught = np.cumsum(y[::-1])[::-1]
    f1 = 2 * caught / (np.arange(len(z), 0, -1) + max(y.sum(), 1))
    best = np.flatnonzero(f1 == f1.max())[0]
    return float(z[best] - 0.5 if best == 0 else (z[best] + z[best - 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Net:
    """Fits on at most `most` documents of each label, of up to MOST_CHARS characters. labels: (key, toxic)."""
    marked = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(F.max("toxic").alias("toxic"))
    ids = [marked.where(f"toxic = {y}").orderBy(F.xxhash64("_id"), "_id").limit(most) for y in (0, 1)]
    sample = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * most rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.binary())], ["id", "toxic", "lang", "x"])

    rows = docs.where(F.length(text) <= MOST_CHARS).select(key, text, lang).join(sample, F.col(key) == F.col("_id")).select(F.col("_id").cast("long").alias("id"), F.col("toxic").cast("int"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = sorted({(r.id, r.x): r for r in rows.mapInArrow(run, "id long, toxic int, lang string, x binary").collect()}.values(), key=lambda r: (r.id, r.x))
    net, x, y = Net.fresh(), [np.frombuffer(r.x, np.int32) for r in found], np.array([r.toxic for r in found], np.float32)
    if min((y == 1).sum(), (y == 0).sum()) < LEAST_LABELLED:
        return net
    back = np.array([zlib.crc32(f"held{r.id}".encode()) % 5 == 0 for r in found])
    fit = np.flatnonzero(~back) if len({*y[~back].tolist()}) == 2 else np.arange(len(y))
    check = np.flatnonzero(back) if len({*y[back].tolist()}) == 2 else fit
    net.learn_languages([x[i] for i in fit], [found[i].lang for i in fit])
    net.train([x[i] for i in fit], y[fit])
    net.calibrate([x[i] for i in check], y[check])
    net.trained = True
    return net


def score(docs: DataFrame, net: Net, text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a column of scores from 0 to 1. The net has a fixed size and is broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pickle.loads(model.value)
        for part in parts:
            pieces = [part.iloc[i : i + PIECE] for i in range(0, max(len(part), 1), PIECE)]
            yield pd.Series(np.concatenate([own.scores([features(t) for t in piece]) for piece in pieces]))
        _CACHE.clear()  # workers outlive their tasks

    return docs.withColumn(name, scored(F.col(text).cast("string")))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    side = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = train(docs.where(~side), table(spark, sf_dir, "labels").where(~side))
    scored = score(docs, net, name="score")
    return scored.select("doc_id", side.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
