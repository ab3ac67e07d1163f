"""Structured Streaming: records are chunked as they arrive, and each batch is merged into the index without duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.records import index_chunks


def record_stream(spark: SparkSession, folder: str, schema: str, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def start_ingest(records: DataFrame, out: str, checkpoint: str, size: int = 500, overlap: int = 50, embed: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Chunks of arriving records, appended to Parquet; a chunk_id that is stored already is left out.

    Keys are the state of a streaming dropDuplicates, partitioned by hash: a batch looks up its own keys and never reads what is
    stored. The file sink logs its commits in `out`, so a batch that runs again after a failure is stored once.
    """
    chunks = index_chunks(records, size, overlap).dropDuplicates(["chunk_id"])
    chunks = embed(chunks) if embed else chunks
    return chunks.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Beyond reference: counts and sums of events per window and type, with a watermark for late rows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Beyond reference: sessions of users, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
