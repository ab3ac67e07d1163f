import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import neardup, tokens

WORD = re.compile(r"[^\W_]+")
VOCABULARY = [f"w{i}" for i in range(60)]


def shingles(t, k):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 2)] = [rng.choice(VOCABULARY)] * rng.randrange(0, 2)
        else:
            w = rng.choices(VOCABULARY, k=rng.randrange(3, 150))
        rows.append((i, " ".join(w) or "x"))
    return rows


def expected(rows, t, k, least):
    sets = {i: shingles(x, k) for i, x in rows if x and len(WORD.findall(x.lower())) >= max(least, k)}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12)


@pytest.mark.parametrize("t,k,least,hot", [(0.6, 3, 10, 50_000), (0.8, 5, 5, 20), (0.6, 1, 1, 10), (0.9, 2, 2, 50_000)])
def test_join_equals_brute_force(spark, monkeypatch, t, k, least, hot):
    rows = corpus()
    df = spark.createDataFrame([*rows, (500, None), (501, ""), (502, "two words")], "rec_id long, text string").withColumn("key", F.lit("clash")).repartition(3)
    monkeypatch.setattr(neardup, "HOT_BUCKET", hot)
    monkeypatch.setattr(neardup, "PAIRS_PER_CELL", 40)
    if hot == 20:
        monkeypatch.setattr(neardup, "MOST_BROADCAST_IDS", 0)  # the join by a shuffle
    members, links = neardup.near_duplicates(df, t=t, k=k, least_words=least)
    got = sorted(map(tuple, neardup.pairs_of_rows(members, links).collect()))
    assert got == expected([*rows, (502, "two words")], t, k, least)
    report = neardup.row_report(members, links).collect()
    assert len(report) == members.count() and all(r.class_id <= r.id for r in report)


def candidates(texts, t, k, least, costs, parts=4):
    _, first, h = neardup.sets_of(pa.array(texts), k, least)
    keys, first, h = neardup._different([(None, neardup.set_keys(first, h), first, h)])
    blobs = neardup.blobs(first, h, keys, costs, t, parts)
    found = []
    for p in range(parts):
        for a, b in neardup.candidate_pairs([r for r in blobs if r[0] == p], t):
            found += zip(a.tolist(), b.tolist())
    sets = {key: set(h[first[i] : first[i + 1]].tolist()) for i, key in enumerate(keys.tolist())}
    linked = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
    return set(found), linked


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("t,k", [(0.6, 3), (0.6, 1), (0.8, 2), (0.5, 4)])
def test_every_link_is_a_candidate(monkeypatch, seed, t, k):
    """Signatures alone must find all links, with levels, maps and split buckets, whatever the sample says of frequencies."""
    rows = corpus(150, seed)
    rng = np.random.default_rng(seed)
    _, _, h = neardup.sets_of(pa.array([x for _, x in rows]), k, k)
    known = np.unique(h)
    known = known[rng.random(len(known)) < 0.6]
    if seed % 2:
        monkeypatch.setattr(neardup, "HOT_BUCKET", 100)
        monkeypatch.setattr(neardup, "POSTINGS_AT_ONCE", 60)
    if seed % 3 == 0:
        monkeypatch.setattr(neardup, "LEAST_SEGMENTS", 3)  # many sets with too few events
    costs = neardup.Costs(known, rng.integers(1, 100, len(known)).astype(float), 100, 150 if seed % 2 == 0 else 10_000)
    found, linked = candidates([x for _, x in rows], t, k, k, costs)
    assert linked <= found and linked


def test_work_grows_with_the_records_of_a_content_only(spark):
    """Records of common shingles only are compared among themselves: candidates of unrelated texts stay few."""
    rng = random.Random(3)
    common = ["hot" + str(i) for i in range(30)]
    texts = [" ".join(rng.sample(common, 25)) for _ in range(100)] + [" ".join(f"r{rng.randrange(10**9)}" for _ in range(60)) for _ in range(1500)]
    found, linked = candidates(texts, 0.6, 3, 5, neardup.Costs(np.zeros(0, np.uint64), np.zeros(0), 0))
    assert linked <= found and len(found) <= 100 * 99 // 2


def test_copies_stay_one_class(spark):
    text = " ".join(VOCABULARY[:40])
    df = spark.createDataFrame([(i, text) for i in range(300)] + [(1000, text + " more")], "rec_id long, text string")
    members, links = neardup.near_duplicates(df, t=0.6, k=3, least_words=10)
    assert links.count() == 1
    kept, neardup.HOT_CLASS = neardup.HOT_CLASS, 50
    try:
        assert neardup.pairs_of_rows(members, links).distinct().count() == neardup.pairs_of_rows(members, links).count() == 300 * 299 // 2 + 300
    finally:
        neardup.HOT_CLASS = kept
    got = {r.id: (r.class_id, r.copies, r.links) for r in neardup.row_report(members, links).collect()}
    assert got[299] == (0, 300, 1) and got[1000] == (1000, 1, 1)


def test_empty_table(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], "rec_id long, text string"))
    assert members.count() == links.count() == 0
    with pytest.raises(ValueError):
        neardup.Join(members, "id", "key", t=1.0)


def test_words_equal_a_regular_expression():
    texts = ["Ünïcode “quoted” words_and 12a", "", None, "a\r\nb", "٣٤ x²", "日本語 テスト", "…", "don't"]
    w = tokens.Words(pa.array(texts))
    assert w.count.tolist() == [len(WORD.findall((t or "").lower())) for t in texts]
    same = tokens.Words(pa.array(["alpha beta", "x alpha", "ALPHA"]))
    assert same.hash[0] == same.hash[3] == same.hash[4]


def test_chunks_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 1_500_000, None, "y", "z" * 5_000_000, ""])], ["id", "text"])
    parts = list(tokens.chunks(batch, "text"))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(5)) and len(parts) > 1
