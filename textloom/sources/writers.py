"""Sinks: JSON lines, the vector store, and resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, append: bool = False, nulls: bool = True) -> None:
    """JSON lines. With nulls, null fields are written, so that absent and null stay apart; a null source_type is filled first."""
    if "source_type" in df.columns:
        df = df.withColumn("source_type", F.coalesce("source_type", F.lit("web")))
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not nulls).lower()).json(path)


def append_new(df: DataFrame, path: str, key: str, schema: str) -> DataFrame:
    """Appends the rows whose key is not stored yet, and returns them as they were selected."""
    from textloom.session import cut
    from textloom.sources.readers import json_lines

    stored = json_lines(df.sparkSession, path, schema, "drop").select(key).distinct()
    new = cut(df.dropDuplicates([key]).join(stored, key, "left_anti"))
    write_json_lines(new, path, append=True)
    return new


def write_index(chunks: DataFrame, path: str, replace: bool = True) -> None:
    """Chunk records as Parquet, partitioned by source_type, so that filters on it skip files."""
    chunks.write.mode("overwrite" if replace else "append").partitionBy("source_type").parquet(path)
