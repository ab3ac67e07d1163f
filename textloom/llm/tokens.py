"""Words and their hashes for whole Arrow batches, with numpy instead of a loop over rows.

A word is a maximal run of Unicode letters and digits, lower-cased. Texts are handled as UTF-8 bytes: bytes are summed with
powers of an odd base modulo 2^64, so that the hash of any substring is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 2_000_000

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[128:] = True
for _c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _ALNUM[ord(_c)] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that any bits of the result can be used."""
    h = h.astype(U, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> U(30)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(27)
        h *= U(0x94D049BB133111EB)
        h ^= h >> U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n bytes at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 2)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of text each, one row at least; null texts become empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(sizes):
        return
    group = np.maximum(np.cumsum(sizes) - 1, 0) // CHUNK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of string texts in a row, and the offsets (one more than texts)."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(data * up[: len(data)], out=sums[1:], dtype=U)
    return sums


class Words:
    """The words of texts: doc (row), start and end (bytes in data), hash (64 bits), and first (the row's first word)."""

    def __init__(self, texts: pa.Array):
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\p{L}\p{N}\x00-\x7F]", replacement=" ")
        ended = pc.binary_join_element_wise(plain, "", "\n")
        self.data, self.offsets = raw(ended)
        inside = _ALNUM[self.data]
        change = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = change[0::2], change[1::2]
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        sums = prefix_sums(self.data)
        _, down = powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of each run of k words within a row, in order."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = np.zeros(n, dtype=U)
        with np.errstate(over="ignore"):
            for i in range(k):
                h = h * U(BASE) + self.hash[i : i + n]
        whole = self.doc[:n] == self.doc[k - 1 :]
        return self.doc[:n][whole], mix(h[whole])
