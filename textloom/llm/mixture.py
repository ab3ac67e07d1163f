"""Problem 9: mixing sources to target shares.

Sizes are tokens of a public tokenizer. Each source gets as many whole copies as its target holds; the rest is drawn by Pareto
order sampling: documents are ranked by their random odds divided by their inclusion odds (inclusion in proportion to size), and
taken in that order until the rest is filled.

Defined cases: null and empty texts have no tokens and are never used; sources are compared in lower case, trimmed, with blanks
as hyphens; a null or unlisted source is not used; a listed source without documents contributes nothing and stays in the report;
without a total, the largest total is taken at which every source with documents can meet its target.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.ranks import running
from textloom.session import cut

TOKENIZER = os.environ.get("TEXTLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")  # a rank file; the variable names another
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_ROUNDS = 100  # of the inclusion odds; each round but the last makes at least one more document of some source certain
_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s_]+", "-")


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of documents with text; tokens are counted in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["id", "source", "tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), source_name(F.col(source_col)).alias("source"), F.col(text_col).cast("string").alias("text"))
    return picked.where("text IS NOT NULL AND text <> '' AND source IS NOT NULL").mapInArrow(run, "id long, source string, tokens long")


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """For each target: source, share, max_repeats, have (tokens), docs, want, copies and rest. Driver-side: one row per target."""
    goals = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats")).where("source IS NOT NULL AND share > 0")
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
    rows = [r.asDict() for r in goals.join(sums, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["have"], r["docs"], r["repeats"] = r["have"] or 0, r["docs"] or 0, max(r["repeats"] or 0, 0)
    able = [r["have"] * r["repeats"] / r["share"] for r in rows if r["have"] and r["repeats"]]
    size = total if total is not None else int(min(able, default=0))
    for r in rows:
        r["want"] = min(int(r["share"] * size), r["have"] * r["repeats"])
        r["copies"] = min(r["want"] // r["have"], r["repeats"]) if r["have"] else 0
        r["rest"] = r["want"] - r["copies"] * r["have"]
    return rows


def _per_source(rows: list[dict], key: str, kind: str) -> Column:
    """A column with a value per source, written into the plan as a literal map (one entry per target)."""
    known = {r["source"]: r[key] for r in rows}
    return F.create_map(*(F.lit(x).cast(t) for s, v in known.items() for x, t in ((s, "string"), (v, kind))))[F.col("source")] if known else F.lit(None).cast(kind)


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: (id, source, tokens, copies) of used documents; report: a row per target with its real share."""
    spark = docs.sparkSession
    names = [r["source"] for r in targets.select(source_name(F.col("source")).alias("source")).where("source IS NOT NULL").collect()]
    sized = cut(token_counts(docs.where(source_name(F.col(source_col)).isin(names)) if names else docs.limit(0), id_col, text_col, source_col, tokenizer))
    rows = plan(sized, targets, total)
    for r in rows:
        r["c"] = 0.0
    for _ in range(MOST_ROUNDS):  # inclusion min(1, c * tokens), with c so that the expected tokens are the rest
        c = _per_source(rows, "c", "double")
        certain = F.col("tokens") * c >= 1
        sums = {
            r["source"]: r
            for r in sized.where("tokens > 0").groupBy("source").agg(
                F.sum(F.when(certain, F.col("tokens")).otherwise(0)).alias("sure"), F.sum(F.when(certain, 0.0).otherwise(F.col("tokens").cast("double") ** 2)).alias("squares")
            ).collect()  # one row per target
        }
        before = [r["c"] for r in rows]
        for r in rows:
            s = sums.get(r["source"])
            r["c"] = max(0.0, (r["rest"] - s["sure"]) / s["squares"]) if s and s["squares"] else (1e18 if s and r["rest"] else 0.0)
        if all(abs(a - r["c"]) <= 1e-12 * max(a, r["c"]) for a, r in zip(before, rows)):
            break
    else:
        raise RuntimeError("inclusion odds did not settle; raise MOST_ROUNDS")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11).cast("double") + 0.5) / float(1 << 53)
    inclusion = F.least(F.lit(1.0), F.col("tokens") * _per_source(rows, "c", "double"))
    odds = F.when(inclusion >= 1, F.lit(0.0)).when(inclusion <= 0, F.lit(float("inf"))).otherwise((u / (1 - u)) / (inclusion / (1 - inclusion)))
    ordered = running(sized.where("tokens > 0").withColumn("order", odds), "source", ["order", "id"], "tokens")
    chosen = (F.col("before") + F.col("tokens") / 2 <= _per_source(rows, "rest", "long")).cast("int")
    mix = cut(ordered.withColumn("copies", _per_source(rows, "copies", "int") + chosen).where("copies > 0").select("id", "source", "tokens", "copies"))
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    scarce = min((r for r in rows if r["have"] and r["repeats"]), key=lambda r: r["have"] * r["repeats"] / r["share"], default=None) if total is None else None
    goals = spark.createDataFrame([(r["source"], r["share"], r["repeats"], r["docs"], r["have"], r is scarce) for r in rows], "source string, target_share double, max_repeats int, docs long, tokens long, decides_total boolean")
    whole = mix.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    report = (
        goals.join(used, "source", "left")
        .fillna(0, ["used_tokens", "used_docs", "most_copies"])
        .withColumn("actual_share", F.col("used_tokens") / F.lit(float(max(whole, 1))))
    )
    return mix, report
