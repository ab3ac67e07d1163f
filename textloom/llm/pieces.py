"""Problem 6: splitting oversized texts at natural boundaries.

Lexical cohesion: the similarity of the words before and after each boundary, over sliding blocks of sentences, has valleys
where the topic changes. Within each size window the boundary with the deepest valley is taken, paragraph before line before
sentence ends; word ends serve where a window has none of these, and a hard cut where it has no boundary at all.

Defined cases: null and texts up to the limit are one piece (or none for null) and are not cut; offsets and sizes count code
points; a text without any boundary is cut hard and overlaps by exactly the overlap; pieces cover the whole text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
WORD = re.compile(r"[^\W_]+")
BOUNDARY = re.compile(r"([^\S\n]*\n[^\S\n]*\n\s*)|([^\S\n]*\n)|((?<=[.!?…])[\"”’)\]]*\s+)")
SPACE = re.compile(r"\s+")
CLASS_WEIGHT = {1: 0.5, 2: 0.25, 3: 0.0}  # of paragraph, line and sentence ends, against valley depths from 0 to 2


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Ends of sentences, lines and paragraphs (offsets where the next unit starts), and their classes 3, 2, 1."""
    at, kind = [], []
    for m in BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            kind.append(1 if m.group(1) else 2 if m.group(2) else 3)
    return at, kind


def depths(text: str, at: list[int], block: int = 3) -> list[float]:
    """Depth of the similarity valley at each boundary: how far the peaks to its left and right rise above it."""
    edges = [0, *at, len(text)]
    bags = [Counter(w for w in WORD.findall(text[a:b].lower()) if len(w) > 3) for a, b in zip(edges, edges[1:])]
    left: Counter = Counter()
    right: Counter = Counter()
    for bag in bags[1 : 1 + block]:
        right.update(bag)
    similarity = []
    for i in range(1, len(bags)):
        left.update(bags[i - 1])
        if i - 1 - block >= 0:
            left.subtract(bags[i - 1 - block])
            left = +left
        if i > 1:
            right.subtract(bags[i - 1])
            right = +right
            if i - 1 + block < len(bags):
                right.update(bags[i - 1 + block])
        dot = sum(n * right[w] for w, n in left.items() if w in right)
        size = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        similarity.append(dot / size if size else 0.0)
    out = []
    n = len(similarity)
    climb_left, climb_right = [0.0] * n, [0.0] * n
    for i in range(n):
        climb_left[i] = max(similarity[i], climb_left[i - 1]) if i and similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 1, -1, -1):
        climb_right[i] = max(similarity[i], climb_right[i + 1]) if i < n - 1 and similarity[i + 1] >= similarity[i] else similarity[i]
    for i, s in enumerate(similarity):
        out.append(climb_left[i] - s + climb_right[i] - s)
    return out


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    if len(text) <= limit:
        return [(0, len(text))]
    at, kind = boundaries(text)
    deep = depths(text, at) if at else []
    out, start = [], 0
    while len(text) - start > limit:
        low, high = start + limit // 2, start + limit
        i, j = bisect_left(at, low), bisect_right(at, high)
        if i == j:
            i = bisect_right(at, start + overlap + 1)
        if i < j:
            end = at[max(range(i, j), key=lambda x: (deep[x] + CLASS_WEIGHT[kind[x]], at[x]))]
        else:
            end = next((high - k for k in range(high - start - overlap - 1) if text[high - k - 1].isspace() != text[high - k].isspace() or text[high - k - 1].isspace()), high)
        out.append((start, end))
        back = end - overlap
        if overlap and not (text[back - 1].isspace() and not text[back].isspace()):
            m = SPACE.search(text, back, end)
            back = m.end() if m and m.end() < end else back
        start = back
    out.append((start, len(text)))
    return out


def pieces(rows: DataFrame, id_col: str = "rec_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = True) -> DataFrame:
    """(id, piece_no, start, end, piece) of each text, of those over the limit only by default. Narrow: no shuffle."""
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    if oversized_only:
        picked = picked.where(F.length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, a, b, text = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (x, y) in enumerate(spans(t, limit, overlap)):
                    ids.append(i), no.append(k), a.append(x), b.append(y), text.append(t[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(text, pa.string())], ["id", "piece_no", "start", "end", "piece"])

    return picked.mapInArrow(run, "id long, piece_no int, start int, end int, piece string")
