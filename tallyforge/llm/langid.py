"""Language spans: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. Its script, that of its first letter, leaves the languages that
used that script in training; each of these scores the word by the log probabilities of its
letters, three- and four-letter windows (hashed, with the word's edges). Viterbi then finds
the labelling of the text's words with the best sum less PENALTY for each change of language. A
text's language is the one with most letters in it.

The model comes from about MOST_TRAIN documents of each language (the share of its documents that gives so many, by a hash of
their ids: no task holds a language's rows), counted in Spark; it has BUCKETS rows and one column for each language, 256 KB. Null text and text without
letters: ``und``, score 0, no spans. An empty table gives an empty result. Without any training text all is ``und``. Ties go to the
language that sorts first. Repeated rows are labelled alike. Texts of any length are labelled whole. Columns other than the id, text and language aren't
looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import table

BUCKETS, MOST_TRAIN, PENALTY = 1 << 16, 1000, 12.0
UNKNOWN, LEAST_SHARE, FORBIDDEN = "und", 0.01, -1e4
# First code points of script ranges and their names; what isn't listed belongs to the range before.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = sorted({n for _, n in SCRIPTS})
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """For each code point, whether it is a letter, and its script; made once in a process."""
    if not _TABLES:
        starts = np.array([s for s, _ in SCRIPTS])
        kinds = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
        _TABLES["script"] = kinds[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
        _TABLES["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES


def windows(text: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a text: places of its letters, hashed windows at each of them, and for each whether a word starts there."""
    t = _tables()
    # one code point for each character, so that places in the lower-cased text are those in the text
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.zeros(len(raw) + 3, np.uint64)
    c[1:-2] = np.where(t["letter"][raw], low if len(low) == len(raw) else raw, 0)
    at = np.flatnonzero(c)
    one, before, after, then = c[at], c[at - 1], c[at + 1], c[at + 2]
    three = (before * np.uint64(0x9E3779B1) + one) * np.uint64(0x85EBCA77) + after
    four = (three + np.uint64(0x27D4EB2F)) * np.uint64(0xC2B2AE3D) + np.where(after > 0, then, 0)
    mix = lambda h, k: ((h ^ (h >> np.uint64(15))) * np.uint64(k) >> np.uint64(16) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return at - 1, [mix(one, 0x2545F4914F6CDD1D), mix(three, 0x9E3779B97F4A7C15), mix(four, 0xBF58476D1CE4E5B9)], before == 0


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages, 0 or FORBIDDEN


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = MOST_TRAIN) -> Model:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h"))
    share = rows.groupBy("lang").agg(F.ceil(F.lit(float(1 << 30) * most) / F.count("*")).alias("below"))  # a row for each language
    sample = rows.join(F.broadcast(share), "lang").where("h < below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script = _tables()["script"]
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = counts.setdefault(n, np.zeros(BUCKETS + len(NAMES), np.int64))
                s = t.as_py()
                at, hashed, _ = windows(s)
                for h in hashed:
                    own[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
                own[BUCKETS:] += np.bincount(script[cp[at]], minlength=len(NAMES))
        for n, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(some)), pa.array(some.astype(np.int32)), pa.array(own[some])], ["lang", "bucket", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    n = np.zeros((BUCKETS + len(NAMES), len(languages)))
    n[counted["bucket"], [languages.index(x) for x in counted["lang"]]] = counted["n"]
    weights = np.log((n[:BUCKETS] + 0.05) / (n[:BUCKETS].sum(axis=0) + 0.05 * BUCKETS)) if languages else np.zeros((BUCKETS, 0))
    share = n[BUCKETS:] / np.maximum(n[BUCKETS:].sum(axis=0), 1)
    use = (share >= LEAST_SHARE) | ~(share >= LEAST_SHARE).any(axis=1, keepdims=True)  # a script that no language uses excludes none
    return Model(languages, weights.astype(np.float32), np.where(use, 0, FORBIDDEN).astype(np.float32))


def _word_scores(texts: list[str], model: Model) -> tuple[list[np.ndarray], ...]:
    """For each text its words' starts and ends, and their scores by language."""
    script, k = _tables()["script"], len(model.languages)
    starts, ends, scores = [], [], []
    for t in texts:
        at, hashed, begins = windows(t)
        if not len(at):
            starts.append(at), ends.append(at), scores.append(np.zeros((0, k), np.float32))
            continue
        w = np.flatnonzero(begins)
        total = model.weights[hashed[0]]
        total += model.weights[hashed[1]]
        total += model.weights[hashed[2]]
        by_word = np.add.reduceat(total, w, axis=0)
        first = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)[at[w]]
        by_word += model.allowed[script[first]]
        starts.append(at[w])
        ends.append(at[np.append(w[1:], len(at)) - 1] + 1)
        scores.append(by_word)
    return starts, ends, scores


def viterbi(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """The best label of each word of each text; all texts go on together, word by word, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    flat = np.concatenate([scores[i] for i in order])
    offset = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    v = flat[offset[: active[0]]].copy()
    last = np.zeros((len(order), flat.shape[1]), np.float32)
    came = np.zeros(len(flat), np.int16)
    change = np.zeros(flat.shape, bool)
    for t in range(1, sizes[0]):
        n = active[t]
        if n < len(v):
            last[n : len(v)] = v[n:]
            v = v[:n]
        best = v.argmax(axis=1)
        top = v[np.arange(n), best] - penalty
        at = offset[:n] + t
        came[at] = best
        change[at] = top[:, None] > v
        v = np.maximum(v, top[:, None]) + flat[at]
    last[: len(v)] = v
    labels = np.zeros(len(flat), np.int64)
    now = last.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        at = offset[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = np.where(change[at, now[:n]], came[at], now[:n])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for i, s, size in zip(order, offset.tolist(), sizes.tolist(), strict=True):
        out[i] = labels[s : s + size]
    return out


def identify(texts: list[str | None], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[dict]]]:
    """(language, score, spans) of each text. The score is the language's share of the letters times how far its sum leads the next."""
    texts = [t or "" for t in texts]
    if not model.languages:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    starts, ends, scores = _word_scores(texts, model)
    out = []
    for s, e, x, labels in zip(starts, ends, scores, viterbi(scores, penalty), strict=True):
        if not len(s):
            out.append((UNKNOWN, 0.0, []))
            continue
        letters = np.bincount(labels, weights=e - s, minlength=len(model.languages))
        best = int(letters.argmax())
        total = x.sum(axis=0, dtype=np.float64)
        lead = total[best] - max([t for i, t in enumerate(total) if i != best], default=total[best] - 50)
        edge = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
        spans = [{"start": int(s[a]), "end": int(e[b - 1]), "lang": model.languages[labels[a]]} for a, b in zip(edge, np.append(edge[1:], len(labels)), strict=True)]
        out.append((model.languages[best], float(letters[best] / letters.sum() / (1 + np.exp(-np.clip(lead / 4, -50, 50)))), spans))
    return out


def label(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, spans: array of (start, end, lang), places in code points). The model has a fixed size and is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for b in batches:
            names, scores, spans = zip(*identify(b.column(1).to_pylist(), own), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>").withColumnRenamed("id", key)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    side = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = label(docs.drop("lang"), train(docs.where(~side)))
    return found.select("doc_id", side.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
