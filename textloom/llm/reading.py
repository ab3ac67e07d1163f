"""Problem 10: reading level of each document.

Interpolated n-gram models (bigram, unigram, uniform) are trained per level on a bounded sample of rated documents; every
document's words get a surprisal under each model; the document's score is the level its surprisals point to, and isotonic
regression on held-out ratings maps scores monotonely to graded difficulty.

Defined cases: null ratings are left out, several ratings of a document count as their median; null, empty and non-English texts
have no level; with no ratings at all every level is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import tokens
from textloom.llm.languages import FUNCTION_WORDS

MAX_TRAINING_DOCS = 4000  # bound of the labelled sample
MAX_TRAINING_BYTES = 16_000_000  # bound of its texts on the driver; beyond it fewer documents are taken, never parts of them
LEVELS = (1, 2, 3, 4)
UNI_BITS, BI_BITS = 16, 18  # models are hashed arrays of fixed size
U = np.uint64


@dataclass
class Model:
    uni: np.ndarray  # per slot and level: probability
    bi: np.ndarray  # per slot and level: probability given the word before
    weights: np.ndarray  # per level: of bigram, unigram and uniform
    sharpness: float
    knots: np.ndarray  # scores
    values: np.ndarray  # levels at the knots, not decreasing

    def surprisals(self, words: tokens.Words) -> np.ndarray:
        """Per word and level, in bits."""
        u, b = _slots(words.hash, words.first)
        p = self.weights[:, 0] * self.bi[b] + self.weights[:, 1] * self.uni[u] + self.weights[:, 2] / (1 << UNI_BITS)
        return -np.log2(p)

    def level(self, means: np.ndarray) -> np.ndarray:
        return np.interp(score(means, self.sharpness), self.knots, self.values)


def _slots(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word and of each word with the one before; a row's first word follows a mark."""
    before = np.concatenate((np.zeros(1, U), h[:-1])) if len(h) else h
    starts = first[:-1][np.diff(first) > 0]
    before = before.copy()
    before[starts] = 0
    with np.errstate(over="ignore"):
        pair = tokens.mix(h * U(3) + before * U(tokens.BASE))
    return (h >> U(64 - UNI_BITS)).astype(np.int64), (pair >> U(64 - BI_BITS)).astype(np.int64)


def score(means: np.ndarray, sharpness: float) -> np.ndarray:
    """The level that mean surprisals point to: levels weighted by how much less their model is surprised."""
    z = -(means - means.min(axis=1, keepdims=True)) * sharpness
    w = np.exp(z)
    return (w * np.array(LEVELS)).sum(axis=1) / w.sum(axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing function of x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, from, to
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, to = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = to
    knots, values = [], []
    for s, n, a, b in blocks:
        for k in (a, b) if b > a else (a,):
            knots.append(k)
            values.append(s / n)
    return np.array(knots), np.array(values)


def _count(words: tokens.Words, level_of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, b = _slots(words.hash, words.first)
    level = level_of_row[words.doc]
    uni = np.zeros((1 << UNI_BITS, len(LEVELS)))
    bi = np.zeros((1 << BI_BITS, len(LEVELS)))
    np.add.at(uni, (u, level), 1)
    np.add.at(bi, (b, level), 1)
    before = np.concatenate(([0], u[:-1])) if len(u) else u
    history = np.zeros((1 << BI_BITS, len(LEVELS)))
    np.maximum.at(history, (b, level), uni[before, level])
    return uni, bi, history


def _row_means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.vstack((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)))
    n = np.maximum(np.diff(first), 1)[:, None]
    return (sums[first[1:]] - sums[first[:-1]]) / n


def fit(texts: list[str], levels: list[int], folds: int = 4) -> Model:
    """Models from all rated texts; the weights, the sharpness and the isotonic map from held-out folds."""
    y = np.array(levels) - 1
    fold = np.arange(len(texts)) % folds
    words = tokens.Words(pa.array(texts, pa.string()))

    def train(use: np.ndarray) -> Model:
        some = tokens.Words(pa.array([t for t, k in zip(texts, use) if k], pa.string()))
        uni, bi, history = _count(some, y[use])
        uni_p = uni / np.maximum(uni.sum(axis=0), 1)
        bi_p = bi / np.maximum(history, 1)
        return Model(uni_p.astype(np.float32), np.minimum(bi_p, 1).astype(np.float32), np.tile([0.3, 0.6, 0.1], (len(LEVELS), 1)), 1.0, np.array([1.0, 4.0]), np.array([1.0, 4.0]))

    held = np.zeros((len(texts), len(LEVELS)))
    weights = []
    for k in range(folds):
        test = fold == k
        model = train(~test)
        out = tokens.Words(pa.array([t for t, z in zip(texts, test) if z], pa.string()))
        u, b = _slots(out.hash, out.first)
        own = y[test][out.doc]
        for level in range(len(LEVELS)):  # expectation maximisation of the interpolation
            at = own == level
            w = model.weights[level]
            for _ in range(12 if at.any() else 0):
                parts = np.stack((w[0] * model.bi[b[at], level], w[1] * model.uni[u[at], level], np.full(at.sum(), w[2] / (1 << UNI_BITS))))
                w = (parts / parts.sum(axis=0)).mean(axis=1)
            model.weights[level] = np.maximum(w, 1e-3) / np.maximum(w, 1e-3).sum()
        weights.append(model.weights)
        held[test] = _row_means(model.surprisals(out), out.first)
    final = train(np.ones(len(texts), bool))
    final.weights = np.mean(weights, axis=0)
    best = None
    for sharpness in (0.5, 1.0, 2.0, 4.0, 8.0):
        s = score(held, sharpness)
        knots, values = isotonic(s, y + 1.0)
        loss = ((np.interp(s, knots, values) - y - 1) ** 2).mean()
        if best is None or loss < best[0]:
            best = (loss, sharpness, knots, values)
    _, final.sharpness, final.knots, final.values = best
    del words
    return final


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_DOCS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MAX_TRAINING_BYTES) -> tuple[list[str], list[int]]:
    """Texts and levels of at most `most` rated documents with most_bytes of text together, the first by a hash of the id."""
    rated = labels.where("level BETWEEN 1 AND 4").select(F.col("doc_id").alias("_id"), "level").groupBy("_id").agg(F.median("level").alias("_level"))
    some = F.broadcast(rated.orderBy(F.xxhash64("_id"), "_id").limit(most))  # bounded by `most`
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL AND _text <> ''").join(some, "_id")
    sizes = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over `most` rows
    kept = rows.orderBy(F.xxhash64("_id"), "_id").limit(most).withColumn("_ahead", F.sum(F.octet_length("_text")).over(sizes)).where(F.col("_ahead") <= most_bytes).collect()
    return [r["_text"] for r in kept], [int(np.floor(r["_level"] + 0.5)) for r in kept]


class English:
    """Which rows are English: the share of English function words beats that of each other language."""

    def __init__(self):
        known: dict[str, list[str]] = {}
        for lang, words in FUNCTION_WORDS.items():
            for w in words:
                known.setdefault(w, []).append(lang)
        self.langs = list(FUNCTION_WORDS)
        names = list(known)
        h = tokens.Words(pa.array(names, pa.string())).hash
        order = np.argsort(h)
        self.hash = h[order]
        table = np.zeros((len(names) + 1, len(self.langs)))
        for i, w in enumerate(names):
            for lang in known[w]:
                table[i, self.langs.index(lang)] = 1 / len(known[w])
        self.table = np.vstack((table[:-1][order], table[-1:]))

    def scores(self, words: tokens.Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        row = np.where(self.hash[at] == words.hash, at, len(self.hash))
        return _row_means(self.table[row], words.first)

    def __call__(self, words: tokens.Words, least: float = 0.08) -> np.ndarray:
        s = self.scores(words)
        own = s[:, self.langs.index("en")]
        rest = np.delete(s, self.langs.index("en"), axis=1).max(axis=1)
        return (own >= least) & (own > 1.3 * rest)


def levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING_DOCS) -> DataFrame:
    """(id, english, difficulty, level, surprisal_mean, surprisal_p50, surprisal_p90) of each document; one narrow pass.

    Surprisals are under the model of the document's own level. difficulty is the isotonic value, level its rounding.
    """
    spark = docs.sparkSession
    texts, rated = training_sample(docs, labels, most, id_col, text_col)
    schema = "id long, english boolean, difficulty double, level int, surprisal_mean double, surprisal_p50 double, surprisal_p90 double"
    shared = spark.sparkContext.broadcast(fit(texts, rated) if texts else None)  # arrays of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, english = shared.value, English()
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                words = tokens.Words(part.column("text"))
                n = np.diff(words.first)
                is_english = english(words) & (n > 0)
                ok = is_english & (model is not None)
                difficulty, grade = np.full(len(n), np.nan), np.zeros(len(n), np.int32)
                stats = np.full((len(n), 3), np.nan)
                if model is not None and len(words.hash):
                    bits = model.surprisals(words)
                    difficulty = model.level(_row_means(bits, words.first))
                    grade = np.clip(np.floor(difficulty + 0.5), 1, 4).astype(np.int32)
                    own = bits[np.arange(len(bits)), grade[words.doc] - 1]
                    order = np.lexsort((own, words.doc))
                    ranked = own[order]
                    some = n > 0
                    stats[some, 0] = _row_means(own[:, None], words.first)[some, 0]
                    stats[some, 1] = ranked[words.first[:-1][some] + (n[some] - 1) // 2]
                    stats[some, 2] = ranked[words.first[:-1][some] + (9 * (n[some] - 1)) // 10]
                columns = [pa.array(difficulty, mask=~ok), pa.array(grade, mask=~ok), *(pa.array(stats[:, k], mask=~ok) for k in range(3))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(is_english), *columns], ["id", "english", "difficulty", "level", "surprisal_mean", "surprisal_p50", "surprisal_p90"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
