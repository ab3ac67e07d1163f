"""Nearest-neighbour retrieval, exact and by cells, with formatting of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut

QUERY_BLOCK = 2048  # queries that are broadcast at once
SAMPLE_VECTORS = 20_000  # for fitting cells


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search_one(index: DataFrame, vector: list[float], k: int = 5, allowed: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k nearest rows of one vector with distance and rank; `allowed` narrows before the ranking. Ties go by id.

    Plan: filter at the scan, then TakeOrderedAndProject; nothing is sorted as a whole.
    """
    query = F.array(*(F.lit(float(x)) for x in vector))
    near = index.where(allowed) if allowed is not None else index
    measure = l2 if metric == "l2" else cosine_distance
    top = near.where(F.col(vector_col).isNotNull()).withColumn("distance", measure(F.col(vector_col), query)).orderBy("distance", id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))  # of k rows


def _blocks(queries: DataFrame, id_col: str, vector_col: str, extra: str | None) -> Iterator[tuple]:
    """The stated queries in blocks, streamed to the driver."""
    ids, vectors, more = [], [], []
    for r in queries.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"), (F.col(extra) if extra else F.lit(None).cast("int")).alias("x")).where("i IS NOT NULL AND v IS NOT NULL").toLocalIterator():
        ids.append(r["i"]), vectors.append(r["v"]), more.append(r["x"])
        if len(ids) == QUERY_BLOCK:
            yield ids, vectors, more
            ids, vectors, more = [], [], []
    if ids:
        yield ids, vectors, more


def _nearly(y: np.ndarray, q: np.ndarray, k: int, metric: str) -> list[np.ndarray]:
    """Rows of y that may be among the k nearest of each query, by a matrix product whose rounding a margin covers."""
    if len(y) <= k:
        return [np.arange(len(y))] * len(q)
    dot = y @ q.T
    own, other = (y * y).sum(axis=1)[:, None], (q * q).sum(axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = own + other - 2 * dot if metric == "l2" else np.nan_to_num(1 - dot / np.sqrt(own * other), nan=-np.inf)
    margin = 1e-9 * (own.max() + other[0]) if metric == "l2" else np.full(len(q), 1e-9)
    bar = np.partition(d, k - 1, axis=0)[k - 1] + 2 * margin
    return [np.flatnonzero(d[:, j] <= bar[j]) for j in range(len(q))]


def search(queries: DataFrame, index: DataFrame, k: int = 5, query_id: str = "query_id", query_vector: str = "embedding", id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", skip_self: bool = False, cell_col: str | None = None, probes_col: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query, exact unless cells are given.

    Queries are a stated set: blocks of them are broadcast, every task ranks its rows against a block with matrix operations and
    passes on k rows per query and batch; only these are shuffled. Null and wrongly sized vectors match nothing; ties go by id.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"), (F.col(cell_col) if cell_col else F.lit(0)).cast("int").alias("c")).where("v IS NOT NULL")
    out = None
    for block in _blocks(queries, query_id, query_vector, probes_col):
        shared = spark.sparkContext.broadcast(block)
        wanted = sorted({c for p in block[2] for c in p}) if probes_col else []

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors, probes = shared.value
            q = np.array(vectors, np.float64)
            own = np.array(ids, np.int64)
            probe = None if probes_col is None else [set(p) for p in probes]
            for batch in batches:
                names = batch.column(0).to_numpy(zero_copy_only=False)
                lists = batch.column(1)
                sized = np.array([v is not None and len(v) == q.shape[1] for v in lists.to_pylist()], bool) if lists.null_count or len(lists.flatten()) != len(lists) * q.shape[1] else np.ones(len(lists), bool)
                at = np.flatnonzero(sized)
                if not len(at):
                    continue
                x = np.array(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), q.shape[1])
                cells = batch.column(2).to_numpy(zero_copy_only=False)[at]
                found_q, found_i, found_d = [], [], []
                for cell in np.unique(cells) if probe is not None else (None,):
                    mine = np.flatnonzero(cells == cell) if probe is not None else np.arange(len(at))
                    asking = [j for j in range(len(own)) if probe is None or int(cell) in probe[j]]
                    if not asking:
                        continue
                    y, its = x[mine], names[at][mine]
                    near = _nearly(y, q[asking], k + skip_self, metric)  # one matrix product; the exact distances of few rows follow
                    for j, close in zip(asking, near):
                        close = close[its[close] != own[j]] if skip_self else close
                        z = y[close]
                        d = np.sqrt(((z - q[j]) ** 2).sum(axis=1)) if metric == "l2" else 1 - (z @ q[j]) / np.sqrt((z * z).sum(axis=1) * (q[j] @ q[j]))
                        best = np.lexsort((its[close], d))[:k]
                        found_q.append(np.full(len(best), own[j])), found_i.append(its[close][best]), found_d.append(d[best])
                if found_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_i).astype(np.int64)), pa.array(np.concatenate(found_d))], ["query_id", "id", "distance"])

        one = (rows.where(F.col("c").isin(wanted)) if probes_col else rows).mapInArrow(run, "query_id long, id long, distance double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _sampled(index: DataFrame, id_col: str, vector_col: str, most: int) -> np.ndarray:
    sample = index.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v"), F.xxhash64(F.col(id_col)).alias("h")).orderBy("h").limit(most).collect()
    return np.array([r["v"] for r in sample], np.float64)


def probes_for(index: DataFrame, centres: np.ndarray, k: int = 5, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", most: int = SAMPLE_VECTORS, asked: int = 200) -> int:
    """How many cells to probe so that a share `recall` of the k nearest is met: measured for `asked` vectors among at most `most`."""
    x = _sampled(index, id_col, vector_col, most)
    if len(x) <= k or not len(centres):
        return max(1, len(centres))
    q = x[:asked]
    d = (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    to = lambda v: (centres * centres).sum(axis=1)[None, :] - 2 * (v @ centres.T)
    own = to(x).argmin(axis=1)
    place = np.argsort(np.argsort(to(q), axis=1, kind="stable"), axis=1)  # of each cell in the order of a query
    needed = np.take_along_axis(place, own[near], axis=1).reshape(-1)
    return int(np.quantile(needed, recall, method="higher")) + 1


def fit_cells(index: DataFrame, cells: int, id_col: str = "vec_id", vector_col: str = "embedding", most: int = SAMPLE_VECTORS, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of k-means over at most `most` vectors, those with the smallest hashes of their ids."""
    x = _sampled(index, id_col, vector_col, most)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def with_cells(df: DataFrame, centres: np.ndarray, vector_col: str = "embedding", probes: int = 1, name: str = "probes") -> DataFrame:
    """df with an array of the nearest `probes` centres of each vector. Vectors that are null or of another size get cell 0."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def nearest(v):
        import pandas as pd

        c = shared.value
        width = c.shape[1] if len(c) else 0
        good = np.array([x is not None and len(x) == width and width > 0 for x in v], bool)
        order = np.zeros((len(v), max(1, min(probes, len(c)))), np.int64)
        if good.any():
            x = np.stack(v[good].to_numpy()).astype(np.float64)
            order[good] = np.argsort((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), axis=1, kind="stable")[:, : order.shape[1]]
        return pd.Series(list(order))

    return df.withColumn(name, nearest(F.col(vector_col)))


def with_cell(df: DataFrame, centres: np.ndarray, vector_col: str = "embedding", name: str = "cell") -> DataFrame:
    """df with the nearest centre of each vector."""
    return with_cells(df, centres, vector_col, 1, "_probes").withColumn(name, F.col("_probes")[0]).drop("_probes")


def write_cells(index: DataFrame, centres: np.ndarray, path: str, vector_col: str = "embedding") -> None:
    """The index with a folder per cell, every row in one."""
    with_cell(index, centres, vector_col).write.mode("overwrite").partitionBy("cell").parquet(path)


def search_cells(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 4, **names) -> DataFrame:
    """search() over the `probes` cells nearest to each query. An index stored by write_cells() has its cells as folders, and those
    that no query probes are not read."""
    celled = index if "cell" in index.columns else with_cell(index, centres, names.get("vector_col", "embedding"))
    probing = with_cells(queries, centres, names.get("query_vector", "embedding"), probes)
    return search(probing, celled, k, cell_col="cell", probes_col="probes", **names)


class HashingEmbedder:
    """Word counts hashed to `size` dimensions, each with a sign, scaled to length 1. A text without words is all zeros."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str | None]) -> list[list[float]]:
        import re
        import zlib

        out = []
        for text in texts:
            v = np.zeros(self.size)
            for w in re.findall(r"[^\W_]+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1.0 if h >> 16 & 1 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def with_embeddings(df: DataFrame, text_col: str, embedder=None, name: str = "embedding") -> DataFrame:
    """df with the embedder's vectors, in Arrow batches. An embedder has embed(list of texts)."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(texts):
        import pandas as pd

        return pd.Series(model.embed(texts.tolist()))

    return df.withColumn(name, run(F.col(text_col)))


def hit_text(title: Column, section: Column, kind: Column, page: Column, link: Column, content: Column) -> Column:
    """A hit as text: source with section and PDF page, link, content. Nulls count as absent and take the defaults."""
    suffix = F.when((F.coalesce(kind, F.lit("web")) == "pdf") & (F.coalesce(page, F.lit(0)) != 0), F.concat(F.lit(" (PDF Page "), page.cast("string"), F.lit(")"))).otherwise("")
    part = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" - "), section)).otherwise("")
    return F.concat(F.lit("Source: "), F.coalesce(title, F.lit("No Title")), part, suffix, F.lit("\nLink: "), F.coalesce(link, F.lit("Unknown URL")), F.lit("\nContent: "), F.coalesce(content, F.lit("")), F.lit("\n\n"))


NO_HITS = "No relevant information found."


def joined_hits(hits: DataFrame, key: str, rank: str, text: str, name: str = "answer") -> DataFrame:
    """Hits of each query in the order of their ranks; the ranks of a query are few (top k)."""
    ordered = F.array_sort(F.collect_list(F.struct(rank, text)))
    return hits.groupBy(key).agg(F.array_join(F.transform(ordered, lambda h: h[text]), "").alias(name))


def citation(title: Column, section: Column, anchor_url: Column, url: Column) -> Column:
    """A markdown link: title and section to the anchor, or the title to the page where there is no section."""
    has = F.coalesce(section, F.lit("")) != ""
    return F.when(has, F.concat(F.lit("["), title, F.lit(" - "), section, F.lit("]("), anchor_url, F.lit(")"))).otherwise(F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")")))


def citation_list(citations: Column) -> Column:
    return F.concat(F.lit("### Sources & Quick Links\n"), F.array_join(F.transform(citations, lambda c: F.concat(F.lit("- "), c)), "\n"))


def answered(questions: DataFrame, index: DataFrame, quick: DataFrame | None = None, k: int = 5, embedder=None) -> DataFrame:
    """(query_id, answer, kind): the quick link of a question where there is one, else the text of its k nearest chunks.

    questions: query_id, question. index: chunk records with embedding. quick: (query_id, answer) of matched quick links.
    """
    asked = cut(with_embeddings(questions.select("query_id", "question"), "question", embedder))
    rest = asked.join(quick.select("query_id"), "query_id", "left_anti") if quick is not None else asked
    numbered = index.withColumn("_n", F.xxhash64("chunk_id", "title", "anchor_url", "url", "source_type"))
    near = cut(search(rest, numbered, k, id_col="_n"))  # chunks that are stored again are hits of their own
    hits = near.join(numbered.withColumnRenamed("_n", "id").drop("embedding").join(near, "id", "left_semi").dropDuplicates(["id"]), "id")
    shown = hits.withColumn("shown", hit_text(F.col("title"), F.col("section_header"), F.col("source_type"), F.col("pdf_page"), F.coalesce("anchor_url", "url"), F.col("document")))
    found = joined_hits(shown, "query_id", "rank", "shown")
    searched = rest.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_HITS)).alias("answer"), F.lit("search").alias("kind"))
    return searched.unionByName(quick.select("query_id", "answer", F.lit("quick_link").alias("kind"))) if quick is not None else searched
