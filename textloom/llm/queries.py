"""Queries of the training-data operators. Each reads whole tables from sf_dir and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import leakage, lines, mainbody, mixture, neardup, pairs, pieces, quality, reading, residue
from textloom.session import cut


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _body_model(spark: SparkSession, sf: str) -> mainbody.Model | None:
    return mainbody.train(_table(spark, sf, "combined_campus_data"), _table(spark, sf, "crawl_pages"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Furniture lines of web rows."""
    found = mainbody.furniture(_table(spark, sf, "combined_campus_data"), _body_model(spark, sf))
    return found.select(F.col("id").alias("rec_id"), "line_no")


def p1_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's main body."""
    return mainbody.main_bodies(_table(spark, sf, "combined_campus_data"), _body_model(spark, sf)).withColumnRenamed("id", "rec_id")


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(_table(spark, sf, "combined_campus_data"), t=0.6, k=3, least_words=30)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of rows with at least 30 words whose sets of three consecutive words overlap by 0.6 or more."""
    return neardup.pairs_of_rows(*_near(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with the class of its equal texts and its number of links to other classes."""
    return neardup.row_report(*_near(spark, sf)).withColumnRenamed("id", "rec_id")


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.scored(cut(quality.profile(_table(spark, sf, "combined_campus_data"), _body_model(spark, sf))))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose main body is a list, a table or junk."""
    return quality.not_prose(_profile(spark, sf)).withColumnRenamed("id", "rec_id")


def p4_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics and outlier score of each row."""
    return _profile(spark, sf).drop("text_hash").withColumnRenamed("id", "rec_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of lines found in at least 8 rows of their site."""
    return lines.repeated_lines(_table(spark, sf, "combined_campus_data")).select(F.col("id").alias("rec_id"), F.col("line_no").cast("int").alias("line_no"))


def p3_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Kept lines with the boilerplate block (connected component of consecutive lines) they belong to."""
    found = lines.repeated_lines(_table(spark, sf, "combined_campus_data"), with_line=True)
    return lines.blocks(found).select(F.col("name").alias("block"), "site", "line", "support")


def p3_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with its text without repeated lines, and how many code points went."""
    rows = _table(spark, sf, "combined_campus_data").select("rec_id", "url", "text")
    clean = lines.without_repeated(rows, lines.repeated_lines(rows))
    return clean.select("rec_id", "clean_text", (F.length("text") - F.length("clean_text")).alias("removed_chars"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Defective responses with field and defect."""
    return pairs.defects(_table(spark, sf, "raft_dataset")).select(F.col("id").alias("raft_id"), "field", "defect")


def _both(spark: SparkSession, sf: str) -> DataFrame:
    names = ("combined_campus_data", "campus_pdfs")
    one, two = (_table(spark, sf, n).select(F.lit(n).alias("table_name"), "rec_id", "text") for n in names)
    return one.unionByName(two)


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the oversized texts of both tables."""
    out = None
    for name in ("combined_campus_data", "campus_pdfs"):
        one = pieces.pieces(_table(spark, sf, name)).select(F.lit(name).alias("table_name"), F.col("id").alias("rec_id"), "piece_no", "start", "end", "piece")
        out = one if out is None else out.unionByName(one)
    return out


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text was cut: those that have a second piece."""
    return p6_pieces(spark, sf).where("piece_no = 1").select("table_name", "rec_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with template residue, dummy copy, error pages or script notices."""
    return residue.residue(_table(spark, sf, "combined_campus_data")).select(F.col("id").alias("rec_id"), "kind")


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without rows of residue."""
    rows = _table(spark, sf, "combined_campus_data")
    return residue.without_residue(rows, residue.residue(rows)).select("rec_id", "title", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items that share 12 consecutive words."""
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select(F.col("id").alias("doc_id"), "item_id")


def p8_near(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and items that share 16 words in a row with at most one word edited, and the longest such run."""
    found = leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"), least_words=16, edits=1)
    return found.select(F.col("id").alias("doc_id"), "item_id", "run")


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mixture with the number of copies of each."""
    mix, _ = mixture.mixture(_table(spark, sf, "documents"), _table(spark, sf, "source_targets"))
    return mix.select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and real share of each source."""
    _, report = mixture.mixture(_table(spark, sf, "documents"), _table(spark, sf, "source_targets"))
    return report.withColumn("actual_share", F.round("actual_share", 6))


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Difficulty and level of each document, with its surprisal distribution."""
    found = reading.levels(_table(spark, sf, "documents"), _table(spark, sf, "reading_labels"))
    return found.withColumnRenamed("id", "doc_id")


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and mean surprisal of each level."""
    return p10_levels(spark, sf).where("english").groupBy("level").agg(F.count("*").alias("docs"), F.round(F.avg("surprisal_mean"), 2).alias("surprisal"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """English documents at level 4."""
    return p10_levels(spark, sf).where("english AND level = 4").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_bodies": p1_bodies,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p3_blocks": p3_blocks,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_statistics": p4_statistics,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
}
