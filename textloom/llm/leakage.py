"""Problem 8: evaluation passages that leaked into documents.

Q-gram lemma filtering: the stated set of items is indexed by character q-grams in blocks of bounded size; every document is
scanned once per block, and shared q-grams are counted in overlapping diagonal bands. Of `least_words` matching words with at most e
edits between them, least_words / (e + 1) follow each other unbroken on both sides, so that all q-grams of this piece lie on one
diagonal; pairs with a band that reaches this are verified by an alignment of words, and reported when a run of words is long enough.

Defined cases: null and short texts of either side match nothing; repeated items and documents are reported each; texts are
compared as their words joined by single spaces, so case and marks do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import tokens

Q = 16
LEAST_WORDS = 12
BLOCK_BYTES = 4_000_000  # of item text that is broadcast at once
U = np.uint64
TABLE_BITS = 22


def joined(words: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words joined by single blanks, and each row's offsets (the last blank of a row belongs to it)."""
    inside = tokens._ALNUM[words.data]
    after = np.concatenate(([False], inside[:-1])) & ~inside
    keep = inside | after
    data = np.where(inside, words.data, np.uint8(32))[keep]
    return data, np.concatenate(([0], np.cumsum(keep)))[words.offsets]


def qgrams(data: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each q-gram that lies within a row."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    sums = tokens.prefix_sums(data)
    _, down = tokens.powers(len(data) + 1)
    with np.errstate(over="ignore"):
        h = (sums[q:] - sums[:n]) * down[:n] * U(0xD6E8FEB86659FD93)
    ok = np.ones(n, bool)
    for e in offsets[1:-1]:
        ok[max(0, e - q + 1) : e] = False
    return np.flatnonzero(ok), h


class Index:
    """Items of one block: q-grams sorted by hash, a table of bits to skip most lookups, and words for the verification."""

    def __init__(self, ids: list[int], texts: list[str], q: int, least_words: int, edits: int = 0):
        piece = -(-least_words // (edits + 1))  # words of the longest unbroken piece, at least
        q = min(q, 2 * piece - 1)  # bytes of a piece of words of one letter
        self.ids, self.q = np.array(ids, np.int64), q
        words = tokens.Words(pa.array(texts, pa.string()))
        data, offsets = joined(words)
        at, h = qgrams(data, offsets, q)
        h = h[at]
        item = np.searchsorted(offsets, at, side="right") - 1
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], (at - offsets[item])[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hash >> U(64 - TABLE_BITS)).astype(np.int64)] = True
        self.words = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])]
        size = words.end - words.start + 1
        self.least_bytes = [int(np.convolve(size[a:b], np.ones(piece, int), "valid").min()) - 1 if b - a >= least_words else 1 << 60 for a, b in zip(words.first, words.first[1:])]

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, diagonal) of each band with enough shared q-grams."""
        at, h = qgrams(data, offsets, self.q)
        at = at[self.table[(h[at] >> U(64 - TABLE_BITS)).astype(np.int64)]] if len(at) else at
        if not len(at):
            return []
        h = h[at]
        left, right = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        count = right - left
        hit = count > 0
        at, left, count = at[hit], left[hit], count[hit]
        if not len(at):
            return []
        place = np.repeat(left - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pos = np.repeat(at, count)
        row = np.searchsorted(offsets, pos, side="right") - 1
        item = self.item[place]
        diagonal = pos - offsets[row] - self.at[place]
        width = 2  # bands overlap by half
        need = np.array([b - self.q + 1 for b in self.least_bytes])
        found = set()
        for shift in (0, width // 2):
            band = (diagonal + shift) // width
            order = np.lexsort((band, item, row))
            r, i, b = row[order], item[order], band[order]
            new = np.concatenate(([True], (np.diff(r) != 0) | (np.diff(i) != 0) | (np.diff(b) != 0)))
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate((first, [len(r)])))
            enough = n >= np.maximum(1, need[i[first]])
            found.update(zip(r[first][enough].tolist(), i[first][enough].tolist(), (b[first][enough] * width - shift).tolist()))
        return sorted(found)


def longest_run(a: np.ndarray, b: np.ndarray, edits: int = 0) -> int:
    """Most matching words of a and b in a row, with at most `edits` words changed, added or left out, by an alignment in bands."""
    best = 0
    reach: list[dict[int, int]] = [{} for _ in range(edits + 1)]
    starts = {}
    for j, w in enumerate(b.tolist()):
        starts.setdefault(w, []).append(j)
    prev: list[dict[int, int]] = [{} for _ in range(edits + 1)]
    for w in a.tolist():
        reach = [{} for _ in range(edits + 1)]
        for j in starts.get(w, ()):
            for e in range(edits + 1):
                n = prev[e].get(j - 1, 0) + 1
                reach[e][j] = max(reach[e].get(j, 0), n)
                best = max(best, reach[e][j])
        for e in range(edits):
            for j, n in prev[e].items():  # a word of a without partner, or another one in its place
                for k in (j, j + 1):
                    if reach[e + 1].get(k, 0) < n:
                        reach[e + 1][k] = n
            for j, n in reach[e].items():  # a word of b without partner
                if reach[e + 1].get(j + 1, 0) < n:
                    reach[e + 1][j + 1] = n
        prev = reach
    return best


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The stated item set in blocks of BLOCK_BYTES of text, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL AND i IS NOT NULL").toLocalIterator():
        if ids and size + len(r["t"]) > BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, edits: int = 0, q: int = Q, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, run): documents and items that share a run of least_words words (with at most `edits` edits). No shuffle."""
    spark = docs.sparkSession
    out = None
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for ids, texts in _blocks(items, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value, q, least_words, edits)
            for batch in batches:
                for part in tokens.chunks(batch, "text"):
                    words = tokens.Words(part.column("text"))
                    data, offsets = joined(words)
                    pairs = sorted({(r, i) for r, i, _ in index.bands(data, offsets)})
                    doc, item, size = [], [], []
                    names = part.column("id").to_pylist() if pairs else []
                    for r, i in pairs:
                        n = longest_run(words.hash[words.first[r] : words.first[r + 1]], index.words[i], edits)
                        if n >= least_words:
                            doc.append(names[r])
                            item.append(int(index.ids[i]))
                            size.append(n)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(size, pa.int32())], ["id", "item_id", "run"])

        one = picked.mapInArrow(run, "id long, item_id long, run int")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "id long, item_id long, run int")
