"""Chunking. Sizes count code points. Null texts give null arrays, empty texts give none (fixed) or one (boundary) chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import let, strip, totalled
from textloom.rules import CHUNK_OVERLAP, CHUNK_SIZE, PDF_CHUNK_OVERLAP, PDF_CHUNK_SIZE, SLICE


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` that start every size - overlap, as long as they start inside the text; the last may lie in the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.when(text.isNull(), F.lit(None)).when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(windows)


def gated_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Fixed windows of texts longer than size; other texts are one chunk."""
    return F.when(F.length(text) > size, fixed_chunks(text, size, overlap)).otherwise(F.array(text))


def slices(text: Column, size: int = SLICE) -> Column:
    """text in slices of `size` without overlap."""
    return fixed_chunks(text, size, 0)


def boundary_chunks(text: Column, size: int = PDF_CHUNK_SIZE, overlap: int = PDF_CHUNK_OVERLAP) -> Column:
    """Windows that end after the last sentence or line end in their last fifth, stripped, empty ones left out.

    A text up to size is one chunk as it is. A window starts overlap before the end of the one before, so tails of mere overlap
    occur. The minimum advance bounds the number of windows.
    """
    return let(text, lambda t: _boundary_chunks(t, size, overlap))


def _boundary_chunks(text: Column, size: int, overlap: int) -> Column:
    fifth = int(size * 0.2)
    least = size - fifth + 2 - overlap
    if overlap < 0 or least <= 0:
        raise ValueError("overlap must be less than four fifths of size")
    n = F.length(text)

    def step(state: Column, _: Column) -> Column:
        begin = state["begin"]
        hard = begin + size
        fold = F.substring(text, hard - fifth + 1, F.lit(fifth))
        ahead = F.length(F.regexp_extract(fold, r"(?s)\A(.*)(?:[.!?] |\n)", 1))
        end = F.when((hard < n) & (ahead > 0), hard - fifth + ahead + 1).otherwise(hard)
        piece = strip(F.substring(text, begin + 1, end - begin))
        moved = F.struct((end - overlap).alias("begin"), F.when(piece == "", state["out"]).otherwise(F.concat(state["out"], F.array(piece))).alias("out"))
        return F.when(begin < n, moved).otherwise(state)

    start = F.struct(F.lit(0).alias("begin"), F.array().cast("array<string>").alias("out"))
    steps = F.sequence(F.lit(1), F.floor(n / least).cast("int") + 2)
    return F.when(n <= size, F.array(text)).otherwise(F.aggregate(steps, start, step)["out"])


def explode_chunks(df: DataFrame, chunks: Column, index: str = "chunk_index", total: str = "total_chunks", text: str = "chunk") -> DataFrame:
    """A row per chunk, with its index from 0 and the number of chunks; other columns are copied. Rows without chunks go."""
    rows = df.select(*df.columns, F.posexplode(totalled(chunks, "item")).alias(index, "_one"))
    return rows.select(*df.columns, F.col("_one.total").alias(total), index, F.col("_one.item").alias(text))
