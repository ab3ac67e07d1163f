"""Problem 2: near-duplicate records by an exact set-similarity join on word shingles.

Universe-partition pigeonhole: the universe of shingles is cut into segments by hash, one partition for each size band. Two sets
with similarity t or more differ in at most H = (1 - t) / (1 + t) * (sum of their sizes) elements. A record is indexed by a subset
of its segments and by one-deletion neighbourhoods of segments, allocated by cost: contents are ordered by their rarity (from
shingle frequencies of a bounded sample), and a record takes the rarest ones until they tolerate more than H differences, H being
that of its largest possible partner. A segment tolerates none if its content is taken, and one if all its neighbours are taken too
(events in the code); as soon as there are more events than differences, a content must be equal.

Why no link is lost: the order is one of contents, the same on both sides. Of a linked pair let z be the record that stops at the
rarer content. Some event of z survives all differences, so a content as rare as z's last one or rarer is equal on both sides, and the
other record, which goes further down in the same order, has taken it as well. Of all contents that are equal take the
rarest: each event above it, on either side, costs a difference, which bounds the sizes of the partners that it may lead to (levels).
The sample steers costs only. Records whose segments have too few events altogether meet in a bucket of their own.

Equal shingle sets form one class from the start: signatures, candidates and links are between classes. Candidates pass sizes, levels
and parity maps, and are then verified exactly. Contents that are expected in more than HOT_BUCKET records are split: each record goes
to a group, and each pair of groups is a bucket.

Defined cases: null texts and texts with fewer than `least_words` words are in no pair; equal texts under different ids are a pair;
rows may repeat without limit, as classes carry them; ids must be distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import tokens
from textloom.session import cut

U = np.uint64
SAMPLE_DOCS = 10_000  # for shingle frequencies, which only steer costs
SAMPLE_LEAST = 3
BAND_STEPS = 2  # a band's sizes span (1 / t)^BAND_STEPS
LEAST_SEGMENTS = 64
SETS_PER_PART = 100_000
LEAST_PARTS = 6
MAP_BITS = 1.3  # bits of a parity map per element of the largest sets of a band
PAIRS_AT_ONCE = 250_000  # few enough for the caches
POSTINGS_AT_ONCE = 1_000_000  # of a part that are searched for pairs together
PAIRS_KEPT = 4_000_000  # found pairs that a task holds before it passes them on
HOT_BUCKET = 50_000  # expected records of a content beyond which its bucket is split
PAIRS_PER_CELL = 50_000  # candidates that are verified together
MOST_BROADCAST_IDS = 2_000_000
HOT_CLASS, HOT_PARTS = 1_000, 64  # classes with more rows are split over this many parts when pairs of rows are listed
GROUP_ROWS = 4_096  # rows whose shingles are hashed together: their number fits 12 bits
ELEMENTS_AT_ONCE = 3_000_000  # of the sets whose postings are made together
GROUP_SETS = 16_384  # sets whose postings are packed together: their number fits 14 bits
LEVELS = 8
ALL_BITS = U((1 << 48) - 1)


def sets_of(texts: pa.Array, k: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first, elements): distinct shingle hashes (52 bits, at the top) of each row with enough words, sorted within rows."""
    if len(texts) > GROUP_ROWS:
        raise ValueError("too many rows at once")
    words = tokens.Words(texts)
    doc, h = words.shingles(k)
    keep = (words.count >= max(least_words, k))[doc]
    packed = np.sort((doc[keep].astype(U) << U(52)) | (h[keep] >> U(12)))
    if not len(packed):
        return np.zeros(0, np.int64), np.zeros(1, np.int64), packed
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    doc = packed >> U(52)
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return doc[start].astype(np.int64), np.concatenate((start, [len(packed)])), packed << U(12)


def set_keys(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of each set as a whole."""
    if len(first) < 2:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(tokens.mix(h + U(0x5851F42D4C957F2D)), first[:-1])
        return tokens.mix(sums + np.diff(first).astype(U) * U(tokens.BASE)).view(np.int64)


class Costs:
    """Rarity of shingles in sixteenths of bits: -log2 of their share of sampled records, the same for all that the sample hardly has."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, sampled: int, rows: int = 0):
        order = np.argsort(hashes)
        self.hash = hashes[order]
        self.bits = np.round(16 * np.log2(np.maximum(max(sampled, 1) / counts[order], 1))).astype(np.int64)
        self.rare = round(16 * math.log2(max(2, sampled / (SAMPLE_LEAST / 2)))) if sampled else 16
        self.rows = rows

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.full(len(h), self.rare)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.bits[at], self.rare)

    def groups(self, bits: np.ndarray) -> np.ndarray:
        """How many groups the records of a shingle are split into."""
        return np.maximum(1, np.ceil(self.rows * np.exp2(-bits / 16) / HOT_BUCKET)).astype(np.int64)


def band_of(size: np.ndarray, t: float) -> np.ndarray:
    return np.floor(np.log(size) / (BAND_STEPS * math.log(1 / t)) + 1e-9).astype(np.int64)


def band_top(band: np.ndarray | int, t: float) -> np.ndarray:
    """Sizes of a band are below this."""
    return np.ceil((1 / t) ** (BAND_STEPS * (np.asarray(band) + 1)) - 1e-9).astype(np.int64)


def segments_of(band: np.ndarray, t: float) -> np.ndarray:
    """Segments of a band: as large as its largest sets can afford, so that their contents are rare."""
    per_segment = 0.5 * (1 + t) / (1 - t)
    return np.maximum(LEAST_SEGMENTS, np.ceil(band_top(band, t) / per_segment)).astype(np.int64)


def differences(both_sizes: np.ndarray, t: float) -> np.ndarray:
    """H: most elements in which linked sets of these sizes, summed, differ."""
    return np.floor(both_sizes * (1 - t) / (1 + t) + 1e-9).astype(np.int64)


def level_ratios(t: float) -> np.ndarray:
    """For each level, the least size of a partner as a share of the record's own."""
    return np.concatenate(([0.0], t ** (1 - 2 * np.arange(1, LEVELS) / LEVELS)))


def _least_two(x: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least of each segment, least of the others of its segment for each element)."""
    least = np.minimum.reduceat(x, start)
    at = np.flatnonzero(x == least[which])
    first = at[np.concatenate(([True], which[at][1:] != which[at][:-1]))]
    rest = x.copy()
    rest[first] = np.iinfo(x.dtype).max
    others = least[which]
    others[first] = np.minimum.reduceat(rest, start)[which[first]]
    return least, others


def signatures(first: np.ndarray, h: np.ndarray, keys: np.ndarray, scheme: np.ndarray, most: np.ndarray, costs: Costs, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, variant, level, hard) under each set's scheme. most: differences it has with a partner there, at most.

    variant is 1 for a one-deletion neighbour; a hard set has too few events and carries the signature of all hard sets besides.
    """
    size = np.diff(first)
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    segment = ((h >> U(32)) * segments_of(scheme, t)[owner].astype(U)) >> U(32)  # sorted as h is
    new = np.concatenate(([True], (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])))
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    count = np.diff(np.concatenate((start, [len(h)])))
    of = owner[start]
    bits = costs(h)
    with np.errstate(over="ignore"):
        element = tokens.mix(h ^ U(0xA0761D6478BD642F))
        content = np.add.reduceat(element, start)
        base = segment[start] * U(0xE7037ED1A0B428DB) + scheme[of].astype(U) * U(0x8EBC6AF09C88C6E3)
        exact = tokens.mix(content + base)
        several = np.flatnonzero(count[which] > 1)
        other = tokens.mix(content[which[several]] - element[several] + base[which[several]])
    weight = np.add.reduceat(bits, start)
    order = lambda b, s: (np.minimum(b, 4095).astype(U) << U(36)) | (s >> U(28))  # noqa: E731 rarity, then hash: the order of contents
    rank = order(weight, exact)
    rank_other = order(weight[which[several]] - bits[several], other)
    events_of, events = of, rank
    if len(several):
        again = np.flatnonzero(count > 1)
        begin = np.searchsorted(which[several], again)
        second = np.minimum(rank[again], np.minimum.reduceat(rank_other, begin))
        events_of, events = np.concatenate((of, of[again])), np.concatenate((rank, second))
    packed = np.sort((events_of.astype(U) << U(48)) | (ALL_BITS - events))
    have = np.bincount(events_of, minlength=n)
    ahead = np.concatenate(([0], np.cumsum(have)[:-1]))

    def event(place: np.ndarray) -> np.ndarray:
        """The place-th event of each set from the rarest one, 0 where it has fewer."""
        at = np.minimum(ahead + place, len(packed) - 1)
        return np.where(place < have, ALL_BITS - (packed[at] & ALL_BITS), U(0))

    last = event(most)
    hard = have <= most
    one = rank >= last[of]
    two = rank_other >= last[owner[several]]
    sets = np.concatenate((of[one], owner[several][two]))
    ranks = np.concatenate((rank[one], rank_other[two]))
    found = np.concatenate((exact[one], other[two]))
    variant = np.concatenate((np.zeros(int(one.sum()), U), np.ones(int(two.sum()), U)))
    level = np.zeros(len(sets), U)
    for ratio in level_ratios(t)[1:]:
        level += ranks < event(differences(size * (1 + ratio), t))[sets]
    split = costs.groups(bits) if costs.rows > HOT_BUCKET else None
    if split is not None and split.max() > 1:
        least, others = _least_two(split, start, which)
        groups = np.concatenate((least[one], others[several][two]))
        back = np.repeat(np.arange(len(sets)), groups)
        partner = np.arange(len(back)) - np.repeat(np.cumsum(groups) - groups, groups)
        own = (tokens.mix(keys.view(U))[sets[back]] % groups[back].astype(U)).astype(np.int64)
        cell = np.minimum(own, partner) * groups[back] + np.maximum(own, partner)
        with np.errstate(over="ignore"):
            found = np.where(groups[back] > 1, tokens.mix(found[back] + cell.astype(U) * U(tokens.BASE)), found[back])
        sets, variant, level = sets[back], variant[back], level[back]
    lost = np.flatnonzero(hard)
    sets = np.concatenate((sets, lost))
    found = np.concatenate((found, tokens.mix(scheme[lost].astype(U) + U(0xD1B54A32D192ED03))))
    nothing = np.zeros(len(lost), U)
    return sets, found, np.concatenate((variant, nothing)), np.concatenate((level, nothing)), hard


def parity_maps(first: np.ndarray, h: np.ndarray, scheme: int, t: float) -> np.ndarray:
    """Bit maps with the parity of the elements that fall on each bit. Their Hamming distance never exceeds the number of elements
    in which two sets differ."""
    n = len(first) - 1
    width = 64 * int(max(1, math.ceil(MAP_BITS * float(band_top(scheme, t)) / 64)))
    owner = np.repeat(np.arange(n), np.diff(first))
    bit = ((tokens.mix(h + U(0x2545F4914F6CDD1D)) >> U(32)) * U(width)) >> U(32)
    flat = np.bincount(owner * width + bit.astype(np.int64), minlength=n * width) & 1
    return np.packbits(flat.reshape(n, width).astype(np.uint8), axis=1).view(U)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 24-bit numbers as 16-bit steps; a step that needs more is 65535 and stands, whole, in a list at the end."""
    steps = np.diff(x, prepend=np.uint32(0)).astype(np.uint32)
    wide = steps >= 65535
    return np.uint32(len(x)).tobytes() + np.where(wide, 65535, steps).astype(np.uint16).tobytes() + steps[wide].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    steps = np.frombuffer(raw, np.uint16, n, 4).astype(np.uint32)
    steps[steps == 65535] = np.frombuffer(raw, np.uint32, -1, 4 + 2 * n)
    return np.cumsum(steps, dtype=np.uint32)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


BLOB = "part int, scheme int, keys binary, sizes binary, maps binary, signatures binary, refs binary, flags binary"
MEMBERS = -1  # a blob with this scheme has ids and keys


def blobs(first: np.ndarray, h: np.ndarray, keys: np.ndarray, costs: Costs, t: float, parts: int) -> list[tuple]:
    """Packed postings by part and scheme, of at most GROUP_SETS different sets."""
    size = np.diff(first)
    band = band_of(size, t)
    largest = np.floor(size / t + 1e-9).astype(np.int64)
    rows: list[tuple] = []
    for step in (0, 1):  # among its own band, and as the smaller one in the next
        top = band_top(band, t)
        mine = np.ones(len(size), bool) if not step else largest >= top
        most = differences(size + (np.minimum(largest, top) if not step else largest), t)
        for scheme in np.unique(band[mine] + step):
            some = mine & (band + step == scheme)
            own_keys, own_size = keys[some], size[some]
            own_first = np.concatenate(([0], np.cumsum(own_size)))
            own_h = h[np.repeat(some, size)]
            sets, sig, variant, level, _ = signatures(own_first, own_h, own_keys, np.full(len(own_size), scheme), most[some], costs, t)
            maps = parity_maps(own_first, own_h, int(scheme), t)
            part = (sig >> U(40)) % U(parts)  # within a part and scheme, 24 bits tell enough; the maps and the verification do the rest
            packed = np.sort((part << U(42)) | ((sig & U(0xFFFFFF)) << U(18)) | (sets.astype(U) << U(4)) | (level << U(1)) | variant)
            bounds = np.searchsorted(packed, np.arange(parts + 1).astype(U) << U(42))
            for p in range(parts):
                x = packed[bounds[p] : bounds[p + 1]]
                if not len(x):
                    continue
                owner = ((x >> U(4)) & U(0x3FFF)).astype(np.int64)
                present = np.zeros(len(own_size), bool)
                present[owner] = True
                local = (np.cumsum(present) - 1)[owner].astype(np.uint16)
                signed = np.where(step, -own_size, own_size)[present].astype(np.int32)  # negative: here as the smaller one
                low = ((x >> U(18)) & U(0xFFFFFF)).astype(np.uint32)
                rows.append((p, int(scheme), own_keys[present].tobytes(), squeeze(signed.tobytes()), maps[present].tobytes(), squeeze(pack_sorted(low)), local.tobytes(), squeeze((x & U(15)).astype(np.uint8).tobytes())))
    return rows


def candidate_pairs(rows: list[tuple], t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller key, larger key) arrays of pairs that share a signature, at least one of them exact, and pass sizes, levels and maps."""
    by_scheme: dict[int, list[tuple]] = {}
    for r in rows:
        by_scheme.setdefault(r[1], []).append(r)
    for group in by_scheme.values():
        yield from _pairs_of_scheme(group, t)


def _pairs_of_scheme(group: list[tuple], t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    keys = np.concatenate([np.frombuffer(r[2], np.int64) for r in group])
    signed = np.concatenate([np.frombuffer(unsqueeze(r[3]), np.int32) for r in group]).astype(np.int64)
    width = len(group[0][4]) // (len(group[0][2]) // 8) // 8
    offset = np.concatenate(([0], np.cumsum([len(r[2]) // 8 for r in group])))
    order = np.lexsort((keys, np.abs(signed)))  # sets by size; equal ones from several batches become one
    new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1])))
    place = np.empty(len(keys), U)
    place[order] = (np.cumsum(new) - 1).astype(U)
    kept = order[new]
    maps = np.concatenate([np.frombuffer(r[4], U).reshape(-1, width) for r in group])[kept]
    keys, signed = keys[kept], signed[kept]
    size, lower = np.abs(signed), signed < 0
    s = np.concatenate(
        [
            (unpack_sorted(unsqueeze(r[5])).astype(U) << U(32)) | (place[np.frombuffer(r[6], np.uint16).astype(np.int64) + offset[i]] << U(4)) | np.frombuffer(unsqueeze(r[7]), np.uint8).astype(U)
            for i, r in enumerate(group)
        ]
    )
    s.sort()
    same = np.concatenate(([True], (s[1:] >> U(32)) == (s[:-1] >> U(32)))) if len(s) else np.zeros(0, bool)
    same[:1] = False
    s = s[same | np.concatenate((same[1:], [False]))]  # signatures of one posting lead nowhere
    if not len(s):
        return
    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
    begins = np.flatnonzero(np.concatenate(([True], (s[1:] >> U(32)) != (s[:-1] >> U(32)))))
    cuts = begins[np.searchsorted(begins, np.arange(0, len(s), POSTINGS_AT_ONCE))[1:] - 1] if len(s) > POSTINGS_AT_ONCE else np.zeros(0, np.int64)
    columns = np.ascontiguousarray(maps.T)
    found: list[np.ndarray] = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)]):  # at the borders of buckets
        for pairs in _meet(s[a:b], size, lower, columns, t) if b > a else ():
            found.append(pairs)
            if sum(map(len, found)) > PAIRS_KEPT:
                found = [np.unique(np.concatenate(found))]
                if len(found[0]) > PAIRS_KEPT // 2:
                    yield _keys_of(found.pop(), keys)
    if found:
        yield _keys_of(np.unique(np.concatenate(found)), keys)


def _keys_of(pairs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, v = keys[pairs >> 32], keys[pairs & 0xFFFFFFFF]
    return np.minimum(u, v), np.maximum(u, v)


def _meet(s: np.ndarray, size: np.ndarray, lower: np.ndarray, columns: np.ndarray, t: float) -> Iterator[np.ndarray]:
    """Pairs of whole buckets of sorted postings (signature, set, level, variant), as set << 32 | set."""
    bucket = np.cumsum(np.concatenate(([False], (s[1:] >> U(32)) != (s[:-1] >> U(32)))))
    owner = ((s >> U(4)) & U(0xFFFFFFF)).astype(np.int64)
    level = ((s >> U(1)) & U(7)).astype(np.int64)
    own_size = size[owner]
    ratio = level_ratios(t)
    sized = (bucket << 32) | own_size
    low = np.searchsorted(sized, (bucket << 32) | np.ceil(ratio[level] * own_size - 1e-6).astype(np.int64))
    high = np.searchsorted(sized, (bucket << 32) | np.floor(own_size / t + 1e-9).astype(np.int64), "right")
    low = np.maximum(low, np.arange(len(s)) + 1)  # the smaller one, or the first of equal size, looks for the other
    n = np.maximum(high - low, 0)
    left = np.flatnonzero(n)
    low, n = low[left], n[left]
    ahead = np.concatenate(([0], np.cumsum(n)))
    most = (1 - t) / (1 + t)
    variant = (s & U(1)).astype(bool)
    least = np.ceil(ratio[level] * own_size - 1e-6).astype(np.int64)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(ahead, ahead[a] + PAIRS_AT_ONCE, "right")) - 1)
        x = np.repeat(left[a:b], n[a:b])
        y = np.arange(ahead[b] - ahead[a]) + np.repeat(low[a:b] - (ahead[a:b] - ahead[a]), n[a:b])
        ok = (own_size[x] >= least[y]) & ~(variant[x] & variant[y])
        x, y = owner[x[ok]], owner[y[ok]]
        ok = (x != y) & ~(lower[x] & lower[y])
        x, y = x[ok], y[ok]
        room = (most * (size[x] + size[y]) + 1e-9).astype(np.int64)
        far = np.zeros(len(x), np.int64)
        for i in range(0, len(columns), 3):
            for column in columns[i : i + 3]:
                far += np.bitwise_count(column[x] ^ column[y])
            ok = far <= room
            x, y, room, far = x[ok], y[ok], room[ok], far[ok]
        a = b
        if len(x):
            yield np.unique((np.minimum(x, y) << 32) | np.maximum(x, y))


def pack_set(h: np.ndarray) -> bytes:
    """The upper 48 bits of each element."""
    return h.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_set(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U).reshape(-1)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
    names = [x.split()[0] for x in BLOB.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _sets_of_batches(k: int, least_words: int):
    """A function from a batch to (ids, keys, first, elements) of its chunks, free of the session."""

    def sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for part in tokens.chunks(batch, "text"):
            for at in range(0, part.num_rows, GROUP_ROWS):
                some = part.slice(at, GROUP_ROWS)
                rows, first, h = sets_of(some.column("text"), k, least_words)
                if len(rows):
                    yield some.column("id").to_numpy(zero_copy_only=False)[rows], set_keys(first, h), first, h

    return sets


def _different(chunks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, elements) of the different sets of some chunks."""
    keys = np.concatenate([c[1] for c in chunks])
    size = np.concatenate([np.diff(c[2]) for c in chunks])
    h = np.concatenate([c[3] for c in chunks])
    kept = np.zeros(len(keys), bool)
    kept[np.unique(keys, return_index=True)[1]] = True
    return keys[kept], np.concatenate(([0], np.cumsum(size[kept]))), h[np.repeat(kept, size)]


class Join:
    """The steps of the join over one table, with its parameters."""

    def __init__(self, rows: DataFrame, id_col: str = "rec_id", text_col: str = "text", t: float = 0.8, k: int = 5, least_words: int = 5):
        if not 0 < t < 1:
            raise ValueError("t must lie between 0 and 1")
        self.t, self.k, self.least_words = t, k, max(least_words, k)
        self.spark = rows.sparkSession
        self._sets = _sets_of_batches(k, self.least_words)
        self._rows = rows
        self.texts = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")

    def costs(self, rows: int) -> Costs:
        """Frequencies of shingles in about SAMPLE_DOCS rows, those with the smallest hashes of their ids; at most the sample's
        shingles / SAMPLE_LEAST values. Equal sets of a batch count once."""
        sets = self._sets
        share = min(1.0, 1.2 * SAMPLE_DOCS / max(rows, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunks = list(sets(batch))
                if chunks:
                    keys, _, h = _different(chunks)
                    element, n = np.unique(h, return_counts=True)
                    number = np.zeros(len(element), np.int64)
                    number[0] = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(number)], ["element", "n", "sets"])

        some = self.texts if share == 1 else self.texts.where(F.xxhash64("id") < F.lit(int(-(1 << 63) + (1 << 64) * share)))
        counted = some.mapInArrow(run, "element long, n long, sets long").groupBy("element").agg(F.sum("n").alias("n"), F.sum("sets").alias("sets"))
        kept = counted.where((F.col("n") >= SAMPLE_LEAST) | (F.col("sets") > 0)).toPandas()
        often = kept[kept["n"] >= SAMPLE_LEAST]
        return Costs(often["element"].to_numpy(np.int64).view(U), often["n"].to_numpy(np.float64), int(kept["sets"].sum()), rows)

    def met(self) -> DataFrame:
        """(a, b, member): ids with their keys (member), and pairs of class keys that share a signature and pass the maps."""
        sets, t = self._sets, self.t
        rows = self._rows.count()
        parts = max(LEAST_PARTS, math.ceil(rows / SETS_PER_PART))
        costs = self.spark.sparkContext.broadcast(self.costs(rows))
        slots = self._slots(parts)

        def pack(chunks: list[tuple]) -> Iterator[pa.RecordBatch]:
            ids, keys = (np.concatenate([c[i] for c in chunks]) for i in (0, 1))
            rows = [(int(ids[0]) % parts, MEMBERS, ids.astype(np.int64).tobytes(), keys.tobytes(), b"", b"", b"", b"")]
            keys, first, h = _different(chunks)
            for at in range(0, len(keys), GROUP_SETS):
                part = first[at : at + GROUP_SETS + 1]
                rows += blobs(part - part[0], h[part[0] : part[-1]], keys[at : at + GROUP_SETS], costs.value, t, parts)
            rows = [(slots[r[0]], *r[1:]) for r in rows]
            for i in range(0, len(rows), 64):
                yield _pack(rows[i : i + 64])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held, size = [], 0
                for chunk in sets(batch):
                    held.append(chunk)
                    size += len(chunk[3])
                    if size > ELEMENTS_AT_ONCE:
                        yield from pack(held)
                        held, size = [], 0
                if held:
                    yield from pack(held)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blobs_: list[tuple] = []
            pair = lambda a, b, member: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), member))], ["a", "b", "member"])
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns)):
                    if r[1] == MEMBERS:
                        yield pair(np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.int64), True)
                    else:
                        blobs_.append(r)
            for a, b in candidate_pairs(blobs_, t):
                yield pair(a, b, False)

        return self.texts.mapInArrow(emit, BLOB).repartition(parts, "part").mapInArrow(meet, "a long, b long, member boolean")

    def _slots(self, parts: int) -> list[int]:
        """A number for each part that hash partitioning puts into a partition of its own; one row per part comes back."""
        numbers = self.spark.range(64 * parts + 1000).select(F.col("id").cast("int").alias("n"))
        found = numbers.groupBy(F.pmod(F.hash("n"), F.lit(parts)).alias("p")).agg(F.min("n").alias("n")).collect()
        slots = {r["p"]: r["n"] for r in found}
        return [slots.get(p, p) for p in range(parts)]

    def links(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """(a, b, similarity): candidates whose similarity is t or more, exactly.

        Both keys of a pair are hashed into groups, a pair of groups is a cell, and a set goes once to each cell that needs it: a set
        with many partners is spread over many cells, and moves less often than it has partners. Sets are moved with 48 bits an
        element, so that one pair in 10^10 of unequal elements counts as equal.
        """
        sets, t = self._sets, self.t
        side = max(1, math.ceil(math.sqrt(pairs.count() / PAIRS_PER_CELL)))
        group = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        cell = F.least(group("a"), group("b")) * side + F.greatest(group("a"), group("b"))
        placed = pairs.select(cell.alias("cell"), "a", "b")
        needs = placed.select("cell", F.col("a").alias("key")).unionByName(placed.select("cell", F.col("b").alias("key")))
        cells = needs.distinct().groupBy("key").agg(F.collect_list("cell").alias("cells"))  # at most `side` of each key
        wanted = cut(members.join(cells, "key").groupBy("key").agg(F.min("id").alias("id"), F.first("cells").alias("cells")).select("id", "cells"))
        few = wanted.count() <= MOST_BROADCAST_IDS

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = dict(zip(batch.column("id").to_pylist(), batch.column("cells").to_pylist()))
                for ids, keys, first, h in sets(batch):
                    rows = [(cell, key, raw) for i, key, a, b in zip(ids.tolist(), keys.tolist(), first, first[1:]) for raw in (pack_set(h[a:b]),) for cell in of[i]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["cell", "a", "elements"])

        moved = self.texts.join(F.broadcast(wanted) if few else wanted, "id").mapInArrow(pick, "cell long, a long, elements binary")
        nothing = F.lit(None)
        moved = moved.select("cell", "a", nothing.cast("long").alias("b"), "elements")
        both = moved.unionByName(placed.withColumn("elements", nothing.cast("binary")))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, held = None, {}
            for batch in batches:
                a, b, similar = [], [], []
                for cell, u, v, raw in zip(*(batch.column(c).to_pylist() for c in ("cell", "a", "b", "elements"))):
                    if cell != here:
                        here, held = cell, {}
                    if raw is not None:
                        held[u] = unpack_set(raw)
                        continue
                    joined = np.concatenate((held[u], held[v]))
                    joined.sort()
                    shared = np.count_nonzero(joined[1:] == joined[:-1])
                    j = shared / (len(joined) - shared)
                    if j >= t - 1e-12:
                        a.append(u), b.append(v), similar.append(j)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

        ordered = both.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull())
        return ordered.mapInArrow(verify, "a long, b long, similarity double")


def near_duplicates(rows: DataFrame, id_col: str = "rec_id", text_col: str = "text", t: float = 0.8, k: int = 5, least_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each row (id, key), and linked pairs of different classes with their similarity."""
    join = Join(rows, id_col, text_col, t, k, least_words)
    met = cut(join.met())
    members = met.where("member").select(F.col("a").alias("id"), F.col("b").alias("key"))
    pairs = cut(met.where("NOT member").select("a", "b").distinct())
    return members, cut(join.links(pairs, members))


def pairs_of_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: links and classes written out as pairs of rows. Grows with the square of a class: a listing
    that asks for every pair has that many rows."""
    large = members.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_CLASS).select("key", F.lit(True).alias("_hot"))
    marked = members.join(large, "key", "left")
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS))).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    m = marked.select("key", "id", spread.cast("int").alias("part")).alias("m")
    n = marked.select("key", "id", F.explode(every).alias("part")).alias("n")
    inside = m.join(n, (F.col("m.key") == F.col("n.key")) & (F.col("m.part") == F.col("n.part")) & (F.col("m.id") < F.col("n.id"))).select(F.col("m.id").alias("rec_a"), F.col("n.id").alias("rec_b"))
    left = links.join(members.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("key").alias("b"), F.col("id").alias("y")), "b")
    return inside.unionByName(left.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")))


def row_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): one row per record. class_id is the class's smallest id, copies the rows of its class, links
    the different classes it is linked with."""
    classes = members.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    degree = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("links"))
    facts = classes.join(degree, "key", "left").fillna(0, ["links"])
    return members.join(facts, "key").select("id", "class_id", "copies", "links")
