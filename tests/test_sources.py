import json

import pytest
from pyspark.sql import functions as F

from textloom import schemas
from textloom.operators import records
from textloom.sources import readers, writers
from textloom.streaming import ingest


def test_json_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"question": "q", "answer": "a"}\n\n{"question": "r", "answer": null}\n{broken\n')
    s = "question string, answer string"
    with pytest.raises(Exception):
        readers.json_lines(spark, str(f), s).collect()
    assert len(readers.json_lines(spark, str(f), s, "drop").collect()) == 2
    assert sum(r._corrupt_record is not None for r in readers.json_lines(spark, str(f), s, "keep").collect()) == 1
    assert readers.json_lines(spark, str(tmp_path / "none"), s).count() == 0
    assert readers.first_existing(spark, [str(tmp_path / "none"), str(f)]) == str(f)
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "none")])


def test_absent_and_null_keys(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in ({"url": "u"}, {"url": "u", "anchor_url": None, "persona": None}, {"url": "u", "anchor_url": "v", "persona": "p"})))
    df = readers.json_lines_absent(spark, str(f), "url string, anchor_url string, persona string", {"anchor_url": "url"}, {"persona": "all"})
    assert [(r.anchor_url, r.persona) for r in df.collect()] == [("u", "all"), (None, None), ("v", "p")]


def test_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("1", None, None), ("2", "é\n", "pdf")], "k string, t string, source_type string")
    writers.write_json_lines(df, path)
    back = readers.json_lines(spark, path, "k string, t string, source_type string").orderBy("k").collect()
    assert [tuple(r) for r in back] == [("1", None, "web"), ("2", "é\n", "pdf")]
    more = spark.createDataFrame([("2", "x", "web"), ("3", "y", "web"), ("3", "y", "web")], df.schema)
    assert [r.k for r in writers.append_new(more, path, "k", "k string, t string, source_type string").collect()] == ["3"]
    assert readers.json_lines(spark, path, "k string").count() == 3


def test_pages_and_pdfs(spark, tmp_path):
    def fetch(url):
        if url == "bad":
            raise OSError
        return {"html": "<p>", "markdown": url, "success": True, "metadata": {"title": 1}}

    urls = spark.createDataFrame([("a",), ("bad",)], "url string")
    got = readers.fetched(spark, urls, fetch).orderBy("url").collect()
    assert [(r.url, r.markdown, r.success, r.metadata) for r in got] == [("a", "a", True, {"title": "1"}), ("bad", None, False, {})]
    (tmp_path / "x.pdf").write_bytes(b"2")
    (tmp_path / "y.pdf").write_bytes(b"?")

    def parse(content):
        return {"title": "T", "pages": [[{"type": 0, "lines": [{"spans": [{"text": str(k)}]}]}] for k in range(int(content))]}

    pages = readers.pdf_pages(spark, str(tmp_path), parse).orderBy("page_no").collect()
    assert [(r.page_count, r.page_no, r.blocks[0].lines[0].spans[0].text) for r in pages] == [(2, 0, "0"), (2, 1, "1")]
    (tmp_path / "map.xml").write_text("<urlset><url><loc>\n u1 </loc></url><url><loc>u2</loc></url></urlset>")
    assert [r.url for r in readers.sitemap(spark, str(tmp_path / "map.xml")).collect()] == ["u1", "u2"]
    n = spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "k string, page_count int")
    assert sorted((r.k, r.page_no) for r in readers.page_range(n).collect()) == [("a", 0), ("a", 1)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("u", "a", "t", "s", "x" * 700, "p", "web", "h1", 0, k) for k in range(5)] + [(None, None, None, None, None, None, None, None, None, None)], "url string, anchor_url string, title string, section_header string, text string, persona string, source_type string, header_level string, pdf_page int, chunk_index int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = df.schema.simpleString()
    for _ in range(2):
        stream = ingest.record_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
        ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        df.limit(5).write.mode("append").parquet(str(tmp_path / "in"))  # rows delivered again
    batch = {r.chunk_id for r in records.index_chunks(df).collect()}
    stored = [r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(stored) == sorted(batch) and schema


def test_schemas_parse(spark):
    for s in (schemas.SECTION, schemas.PDF_CHUNK, schemas.COMBINED, schemas.CHUNK, schemas.RAFT, schemas.FAQ, schemas.PAGE, schemas.PDF_PAGE, schemas.CHAT):
        assert spark.createDataFrame([], s).count() == 0


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0, 1), ("2024-01-01 00:20:00", "a", 2.0, 1), ("2024-01-01 02:00:00", "a", 4.0, 1)], "ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in ingest.windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in ingest.sessions(df).collect()) == [1, 2]
