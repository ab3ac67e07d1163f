"""Sources: JSON lines, crawled pages, PDF pages, sitemaps and the vector store."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    if not urlparse(path).scheme:
        return os.path.exists(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """Records of JSON lines; blank lines are skipped.

    "strict" fails at a malformed line, "drop" leaves such lines out, "keep" has them in _corrupt_record. A missing path gives no
    records.
    """
    if mode not in ("strict", "drop", "keep"):
        raise ValueError("mode is strict, drop or keep")
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if mode == "keep":
        return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "FAILFAST" if mode == "strict" else "DROPMALFORMED").json(path)


def json_lines_absent(spark: SparkSession, path: str, schema: str, fallbacks: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """Records of JSON lines in which an absent key takes another column or a default, while an explicit null stays null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path).where(F.trim("value") != "")
    row = raw.select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.json_object_keys("value").alias("keys")).select("r.*", "keys")
    for column, other in fallbacks.items():
        row = row.withColumn(column, F.when(F.array_contains("keys", column), F.col(column)).otherwise(F.col(other)))
    for column, value in defaults.items():
        row = row.withColumn(column, F.when(F.array_contains("keys", column), F.col(column)).otherwise(F.lit(value)))
    return row.drop("keys")


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first of the paths that exists; an error if none does."""
    tried = list(paths)
    for p in tried:
        if exists(spark, p):
            return p
    raise FileNotFoundError("none of these exists: " + ", ".join(tried))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def page_range(df: DataFrame, count_col: str = "page_count", name: str = "page_no") -> DataFrame:
    """A row per page from 0; none for a null or non-positive count."""
    return df.where(F.coalesce(F.col(count_col) > 0, F.lit(False))).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(count_col) - 1)))


def fetched(spark: SparkSession, urls: DataFrame, fetch: Callable[[str], dict], url_col: str = "url", per_second: float | None = None) -> DataFrame:
    """Pages of urls by a client that returns html, markdown, success and metadata; a failing client gives success = false."""
    import time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                if per_second:
                    time.sleep(1 / per_second)
                try:
                    page = fetch(url)
                except Exception:  # the client's failures are pages without success
                    page = {}
                rows.append((url, page.get("html"), page.get("markdown"), bool(page.get("success")), [(k, str(v)) for k, v in (page.get("metadata") or {}).items()]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["url", "html", "markdown", "success", "metadata"])

    return urls.select(F.col(url_col).alias("url")).mapInArrow(run, schemas.PAGE)


def downloaded(files: DataFrame, folder: str, fetch: Callable[[str], bytes], key_col: str = "pdf_key", url_col: str = "url") -> DataFrame:
    """(key, path, ok, cached): files of urls, kept as <key>.pdf in a folder that all executors mount.

    A file that is there is not fetched again. A failing fetch gives ok = false and leaves no file; a file appears only whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = folder.removeprefix("file:")
        os.makedirs(base, exist_ok=True)
        for batch in batches:
            rows = []
            for key, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(base, f"{key}.pdf")
                cached = os.path.exists(path)
                ok = cached
                if not cached:
                    try:
                        content = fetch(url)
                        part = f"{path}.{os.getpid()}.part"
                        with open(part, "wb") as out:
                            out.write(content)
                        os.replace(part, path)
                        ok = True
                    except Exception:  # the client's failures are files without success
                        ok = False
                rows.append((key, path, ok, cached))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "path", "ok", "cached"])

    return files.select(F.col(key_col).cast("string").alias("key"), F.col(url_col).alias("url")).mapInArrow(run, "key string, path string, ok boolean, cached boolean")


def pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], dict]) -> DataFrame:
    """(path, page_count, title, author, subject, page_no, blocks) of PDF files, one task per file, opened once.

    parse returns metadata and the layout tree of each page; a file that it can't read gives no pages.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    tree = pa.list_(pa.struct([("type", pa.int32()), ("lines", pa.list_(pa.struct([("spans", pa.list_(pa.struct([("text", pa.string())])))])))]))
    names = ["path", "page_count", "title", "author", "subject", "page_no", "blocks"]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    doc = parse(content)
                except Exception:  # unreadable files have no pages
                    continue
                pages = doc.get("pages") or []
                rows = [(name, len(pages), doc.get("title"), doc.get("author"), doc.get("subject"), k, blocks) for k, blocks in enumerate(pages)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    blocks = "array<struct<type:int,lines:array<struct<spans:array<struct<text:string>>>>>>"
    return files.mapInArrow(run, f"path string, page_count int, title string, author string, subject string, page_no int, blocks {blocks}")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url): the locations of sitemap files, each a whole XML document."""
    docs = spark.read.text(path, wholetext=True)
    return docs.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url"))


def nth_row(df: DataFrame, order: str, n: int) -> DataFrame:
    """The row at an offset in the order of a column."""
    return df.orderBy(order).offset(n).limit(1)
