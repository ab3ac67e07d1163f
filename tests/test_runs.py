"""Crawling, downloads, bounds, matching as a loop, stored cells and streams."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import faq, quality, retrieval, tags, training, urls
from textloom.session import bounded
from textloom.sources import readers
from textloom.streaming import ingest

HOST = "https://a.tarnbrook.example"


def web(seed, n=40):
    rng = random.Random(seed)
    pages = {}
    for i in range(n):
        links = [rng.choice([f"/p{rng.randrange(n)}", f"{HOST}/p{rng.randrange(n)}#top", f"/f{i}.pdf", "https://b.example/x", f"p{rng.randrange(n)}"]) for _ in range(rng.randrange(0, 5))]
        pages[f"{HOST}/p{i}"] = (rng.random() < 0.8, "".join(f'<a href="{x}">t</a>' for x in links))
    return pages


def loop(pages, start, most):
    """The queue as a plain loop."""
    from urllib.parse import urljoin

    queue, seen, done, left = deque(start), set(start), [], most
    while queue and left > 0:
        url = queue.popleft()
        ok, html = pages.get(url, (False, ""))
        done.append((url, ok))
        if not ok:
            continue
        left -= 1
        for part in html.split('href="')[1:]:
            target = urljoin(url, part.split('"')[0]).split("#")[0]
            if target not in seen and "tarnbrook.example" in target and not target.endswith(".pdf"):
                seen.add(target)
                queue.append(target)
    return done


@pytest.mark.parametrize("seed,most", [(1, 3), (2, 8), (3, 1000), (4, 0)])
def test_crawl_is_the_queue(spark, seed, most):
    pages = web(seed)
    stored = spark.createDataFrame([(u, h, "text", ok, {"status": "200"}) for u, (ok, h) in pages.items()], "url string, html string, markdown string, success boolean, metadata map<string,string>")
    fetch = lambda wanted: wanted.join(stored, "url", "left")
    start = [f"{HOST}/p{i}" for i in (0, 1, 2, 3)]
    seeds = spark.createDataFrame([(u, i) for i, u in enumerate(start)] + [(None, 9), (start[0], 7)], "url string, place long")
    got = urls.crawl(seeds, fetch, most).orderBy("place").select("url", "success").collect()
    assert [tuple(r) for r in got] == loop(pages, start, most)


def test_unfinished_graphs_raise(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "url string")
    assert urls.reachable(chain, seeds, most_levels=7).count() == 7
    with pytest.raises(RuntimeError):
        urls.reachable(chain, seeds, most_levels=3)


def test_bounds_raise(spark, monkeypatch):
    df = spark.range(5)
    assert len(bounded(df, 5, "rows")) == 5
    with pytest.raises(ValueError):
        bounded(df, 4, "rows")
    links = spark.createDataFrame([(i, f"c{i}", f"u{i}", [f"w{i}"]) for i in range(3)], "faq_ix int, category string, url string, keywords array<string>")
    monkeypatch.setattr(tags, "MOST_QUICK_LINKS", 2)
    monkeypatch.setattr(faq, "MOST_KEYWORDS", 2)
    with pytest.raises(ValueError):
        tags.quick_link_category(spark.createDataFrame([("u1",)], "url string"), links)
    with pytest.raises(ValueError):
        faq.match(spark.createDataFrame([("w1",)], "question string"), links)


def matched(question, keywords, threshold=0.4):
    """The matcher as a loop over keywords in order."""
    q, best, found = question.lower(), 0.0, None
    for k in keywords:
        if k in q:
            score = len(k) / max(len(q), len(k)) + (0.3 if f" {k} " in f" {q} " or q.startswith(k) or q.endswith(k) else 0.0)
            if score > best:
                best, found = min(score, 1.0), k
    return found if best >= threshold else None


def test_the_last_score_above_one_wins(spark):
    rng = random.Random(8)
    keywords = ["login login", "login logins", "login", "logins", "gin", "log"]
    questions = ["login logins", "Login Login", "login", "logins now", "gin"] + ["".join(rng.choices(["login", "logins", " ", "gin", "x"], k=rng.randrange(1, 5))) for _ in range(40)]
    links = spark.createDataFrame([(0, "a", keywords[:3]), (1, "b", keywords[3:])], "faq_ix int, category string, keywords array<string>")
    df = spark.createDataFrame([(q,) for q in questions] + [(None,), ("",)], "question string")
    got = {r.question: r.keyword for r in faq.match(df, links).collect()}
    assert got == {q: k for q in questions if (k := matched(q, keywords))}
    assert got["login logins"] == "login logins"


def test_downloads_are_cached_and_failures_leave_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a", "u1"), ("b", "bad"), ("c", "u3")], "pdf_key string, url string")

    def client(url):
        if url == "bad":
            raise OSError
        return url.encode()

    first = {r.key: (r.ok, r.cached) for r in readers.downloaded(files, str(tmp_path), client).collect()}
    assert first == {"a": (True, False), "b": (False, False), "c": (True, False)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "c.pdf"]
    assert {r.key: r.cached for r in readers.downloaded(files, str(tmp_path), client).collect()} == {"a": True, "b": False, "c": True}
    assert readers.downloaded(files.limit(0), str(tmp_path), client).count() == 0


def test_exit_status_and_reports(spark):
    pages = spark.createDataFrame([(True,), (False,), (None,)], "success boolean")
    row = quality.crawl_report(pages, spark.range(4)).first()
    assert (row.crawled, row.failed, row.sections, row.per_page, row.exit_status) == (1, 2, 4, 4.0, 1)
    assert quality.crawl_report(pages.where("success"), spark.range(0)).first().exit_status == 0
    made = spark.createDataFrame([("x",), (None,)], "generated string")
    assert tuple(quality.training_report(made).first()) == (1, 1, 0.02)


def test_generation_rests(spark, monkeypatch):
    import time

    began = time.perf_counter()
    df = spark.createDataFrame([("p",)] * 4, "prompt string").coalesce(1)
    assert training.generate(df, "prompt", lambda p: p, rest_every=2, rest_seconds=0.3).count() == 4
    assert time.perf_counter() - began >= 0.6


def test_cells_are_folders_and_others_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 4)) + 20 * k for k in range(5)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<float>")
    centres = retrieval.fit_cells(df, 5)
    retrieval.write_cells(df, centres, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert stored.count() == 301
    asked = df.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), "embedding")
    near = retrieval.search_cells(asked, stored, centres, 5, probes=1)
    assert "cell#" in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]")[0]
    d = ((x.astype(np.float32).astype(float) - x[3].astype(np.float32)) ** 2).sum(axis=1)
    assert [r.id for r in near.orderBy("rank").collect()] == np.lexsort((np.arange(300), d))[:5].tolist()


def test_cells_recall_on_the_test_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id) for r in retrieval.search(asked, e, 5, skip_self=True).collect()}
    centres = retrieval.fit_cells(e, 16)
    near = {(r.query_id, r.id) for r in retrieval.search_cells(asked, e, centres, 5, retrieval.probes_for(e, centres), skip_self=True).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_streams_store_a_chunk_once(spark, tmp_path):
    schema = "url string, anchor_url string, title string, section_header string, persona string, source_type string, header_level string, pdf_page int, chunk_index int, text string"
    rows = [("u", None, "t", None, None, None, None, None, i, f"text {i}") for i in range(6)]
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.start_ingest(ingest.record_stream(spark, str(tmp_path / "in"), schema), out, state).awaitTermination()
    spark.createDataFrame(rows[2:] + rows[:1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.start_ingest(ingest.record_stream(spark, str(tmp_path / "in"), schema), out, state).awaitTermination()
    assert sorted(r.document for r in spark.read.parquet(out).collect()) == [f"text {i}" for i in range(6)]
