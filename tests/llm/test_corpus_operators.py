import random
import re

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import leakage, mixture, reading
from textloom.llm import queries as training_queries

WORD = re.compile(r"[^\W_]+")


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("alpha", "beta", "gam", "de") for b in ("x", "yy", "zed", "q1", "é")]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)))) for k in range(40)] + [(40, None), (41, ""), (42, "short one")]
    items.append((43, items[0][1]))
    docs = [(100 + i, " ".join(rng.choices(vocabulary, k=40))) for i in range(30)]
    for i in range(60):
        w = (items[rng.randrange(40)][1] or "").upper().split()
        a = rng.randrange(max(1, len(w) - 5))
        docs.append((200 + i, f"{docs[i % 30][1]}, {' - '.join(w[a : a + rng.randrange(6, 30)])}. {docs[(i + 7) % 30][1]}"))
    docs += [(900, None), (901, "")]
    run = lambda t: {tuple(w[k : k + 12]) for w in [WORD.findall((t or "").lower())] for k in range(len(w) - 11)}
    want = sorted((d, i) for d, t in docs for i, u in items if run(t) & run(u))
    kept, leakage.BLOCK_BYTES = leakage.BLOCK_BYTES, 2000
    try:
        found = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted((r.id, r.item_id) for r in found.collect()) == want and len(want) > 20
    finally:
        leakage.BLOCK_BYTES = kept
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_edited_runs():
    a = np.arange(30)
    assert leakage.longest_run(a, a) == 30
    b = np.concatenate((a[:14], [99], a[15:]))
    assert leakage.longest_run(a, b) == 15 and leakage.longest_run(a, b, 1) == 29
    assert leakage.longest_run(a, np.delete(a, 10), 1) == 29 and leakage.longest_run(a, np.insert(a, 10, 77), 1) == 30


def test_near_leaks_tolerate_an_edit(spark):
    w = [f"word{i}" for i in range(24)]
    v = w[:11] + ["changed"] + w[12:]
    docs = spark.createDataFrame([(1, "intro text here " + " ".join(v)), (2, " ".join(w[:10]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    assert [(r.id, r.item_id, r.run) for r in leakage.leaks(docs, items, least_words=16, edits=1).collect()] == [(1, 7, 23)]


def test_near_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda most: "".join(rng.choices(letters, k=rng.randrange(1, most)))
    items = [(k, [word(12 if k % 3 else 2) for _ in range(40)]) for k in range(30)]
    docs = []
    for i in range(180):
        n = rng.randrange(13, 21)
        w = items[i % 30][1][5 : 5 + n]
        at = rng.choice((n // 2, rng.randrange(1, n - 1)))
        w = (w[:at] + w[at + 1 :], w[:at] + [word(20)] + w[at:], w[:at] + [word(20)] + w[at + 1 :])[i // 30 % 3]
        docs.append((i, [word(9) for _ in range(15)] + w + [word(9) for _ in range(15)]))
    name = {w: k for k, w in enumerate(sorted({w for _, t in items + docs for w in t}))}
    coded = lambda rows: [(i, np.array([name[w] for w in t])) for i, t in rows]
    want = sorted((d, i, n) for d, t in coded(docs) for i, u in coded(items) if (n := leakage.longest_run(t, u, 1)) >= 16)
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} long, text string")
    found = leakage.leaks(frame(docs, "doc_id"), frame(items, "item_id"), least_words=16, edits=1)
    assert sorted((r.id, r.item_id, r.run) for r in found.collect()) == want and len(want) > 60


def test_mixture_meets_its_targets(spark):
    rng = random.Random(3)
    data = [(i, " ".join(["token"] * rng.randrange(20, 200)), s) for i, s in enumerate(rng.choices(["big", "Mid Dle", "mid-dle", "tiny", "other"], weights=[60, 14, 14, 4, 8], k=900))]
    data += [(10_000, None, "big"), (10_001, "", "big"), (10_002, "text", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid-dle", 0.3, 2), ("TINY", 0.15, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixture.mixture(docs, targets)
    rows = {r.source: r for r in report.collect()}
    assert rows["absent"].used_tokens == 0 and len(rows) == 4
    for s, share in (("big", 0.5), ("mid-dle", 0.3), ("tiny", 0.15)):
        assert abs(rows[s].actual_share - share / 0.95) < 0.01 and rows[s].most_copies <= rows[s].max_repeats
    got = {r.id: r.copies for r in mix.collect()}
    assert got == {r.id: r.copies for r in mixture.mixture(docs, targets)[0].collect()} and 10_000 not in got
    short, small = mixture.mixture(docs, targets, total=2000)
    assert sum(r.used_tokens for r in small.collect()) <= 2400 and short.count() > 0
    large = {r.source: r for r in mixture.mixture(docs, targets, total=10**9)[1].collect()}
    assert large["tiny"].most_copies == 3 and large["tiny"].used_tokens == 3 * large["tiny"].tokens
    none, empty = mixture.mixture(docs.limit(0), targets)
    assert none.count() == 0 and empty.count() == 4
    assert mixture.mixture(docs, targets.limit(0))[1].count() == 0


def test_inclusion_grows_with_size(spark):
    """Over many seeds a text of twice the size is drawn about twice as often."""
    data = [(i, " ".join(["token"] * (40 if i % 2 else 20)), "s") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    drawn = [sum(1 for r in mixture.mixture(docs, targets, total=1200, seed=k)[0].collect() if r.id % 2) for k in range(4)]
    all_drawn = [mixture.mixture(docs, targets, total=1200, seed=k)[0].count() for k in range(4)]
    assert 0.52 < sum(drawn) / sum(all_drawn) < 0.82


def levelled(n, seed):
    rng = random.Random(seed)
    words = {1: "the cat sat on a mat and ran to the big red ball we see".split(), 2: "students must return the form to the office before the term ends so that staff can check it".split(), 3: "the committee found that the curriculum influences retention and evaluation of structural partnership in departments".split(), 4: "the epistemological stratification of institutional legitimacy presupposes the methodological reconfiguration of governance in discourse".split()}
    return [(i, " ".join(rng.choices(words[1 + i % 4], k=60)), 1 + i % 4) for i in range(n)]


def test_levels(spark):
    rows = levelled(240, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "Die Bibliothek erklärt die Warteliste vor dem Freitag und nach der Prüfung " * 3)], "doc_id long, text string").withColumn("level", F.lit("clash"))
    rng = random.Random(4)
    labels = [(i, "r", min(4, max(1, x + rng.choice([0, 0, 0, 0, 1, -1]))) if rng.random() > 0.1 else None, None) for i, _, x in rows[:160]]
    rated = spark.createDataFrame(labels + labels[:20], "doc_id long, rater string, level int, rated_at string")
    out = {r.id: r for r in reading.levels(docs, rated).collect()}
    assert sum(out[i].level == x for i, _, x in rows[160:]) >= 76  # of 80 held out
    assert not out[900].english and out[900].level is None and not out[901].english and not out[902].english and out[902].level is None
    assert all(out[i].surprisal_p50 <= out[i].surprisal_p90 for i, _, _ in rows)
    assert all(r.level is None for r in reading.levels(docs, rated.limit(0)).collect())
    assert reading.levels(docs.limit(0), rated).count() == 0


def test_isotonic_is_monotone_and_least_squares():
    x, y = np.arange(8.0), np.array([1, 3, 2, 2, 5, 4, 6, 6.0])
    knots, values = reading.isotonic(x, y)
    assert np.allclose(np.interp(x, knots, values), [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5, 6, 6]) and (np.diff(values) >= 0).all()


def test_queries_have_fixed_columns(spark, sf):
    columns = {"p1_found": ["rec_id", "line_no"], "p3_found": ["rec_id", "line_no"], "p5_found": ["raft_id", "field", "defect"], "p6_found": ["table_name", "rec_id"], "p7_found": ["rec_id", "kind"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, names in columns.items():
        df = training_queries.QUERIES[name](spark, sf)
        assert df.columns == names and df.count() >= 0
