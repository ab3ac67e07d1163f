"""Filters of records, and counts about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import contains_any
from textloom.rules import ERROR_SIGNS, LEAST_PAGE, LEAST_PDF_PAGE, TRAINING_BOILERPLATE, TRAINING_ERROR_SIGNS, TRAINING_LENGTHS
from textloom.session import bounded

MOST_SOURCES = 10_000  # lines of a report; more are an error


def _empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def error_page(title: Column, text: Column, signs: list[str] | tuple[str, ...] = tuple(ERROR_SIGNS)) -> Column:
    """Whether a sign of an error page is in the title or in the first 200 code points of the text, lower-cased first.

    Signs are plain substrings. Null counts as empty.
    """
    return contains_any(F.lower(_empty(title)), signs) | contains_any(F.left(F.lower(_empty(text)), F.lit(200)), signs)


def training_eligible(title: Column, text: Column) -> Column:
    """Whether a record may become a training row: its length, no sign of an error page, none of boilerplate. Null is not."""
    low, high = TRAINING_LENGTHS
    n = F.length(text)
    return F.coalesce(n.between(low, high) & ~error_page(title, text, tuple(TRAINING_ERROR_SIGNS)) & ~contains_any(F.lower(text), TRAINING_BOILERPLATE), F.lit(False))


def page_long_enough(clean_text: Column) -> Column:
    return F.coalesce(F.length(clean_text) > LEAST_PAGE, F.lit(False))


def pdf_page_long_enough(text: Column) -> Column:
    return F.coalesce(F.length(text) >= LEAST_PDF_PAGE, F.lit(False))


def has_text(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def source_counts(df: DataFrame) -> DataFrame:
    """One row: records, web and pdf records; a null source_type is web, other types count in the total only."""
    kind = F.coalesce("source_type", F.lit("web"))
    return df.agg(F.count("*").alias("total"), F.count_if(kind == "web").alias("web"), F.count_if(kind == "pdf").alias("pdf"))


def ingest_counts(df: DataFrame) -> DataFrame:
    """One row: records with text, of these pdf and all others."""
    kept = df.where(has_text(F.col("text")))
    pdf = F.coalesce(F.col("source_type") == "pdf", F.lit(False))
    return kept.agg(F.count("*").alias("entries"), F.count_if(~pdf).alias("web"), F.count_if(pdf).alias("pdf"))


def merge_counts(df: DataFrame, by: str = "source") -> DataFrame:
    """Per source: records kept, and records filtered as error pages."""
    bad = error_page(F.col("title"), F.col("text"))
    return df.groupBy(by).agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("filtered"))


def dataset_profile(df: DataFrame, seconds: float = 1.2, price: float = 0.02) -> DataFrame:
    """One row: records, eligible ones, pdf and quick-link ones among them, and the estimated minutes and cost."""
    ok = training_eligible(F.col("title"), F.col("text"))
    n = F.count_if(ok)
    return df.agg(
        F.count("*").alias("total"), n.alias("selected"), F.count_if(ok & F.coalesce(F.col("source_type") == "pdf", F.lit(False))).alias("selected_pdf"),
        F.count_if(ok & F.col("faq_category").isNotNull() & (F.col("faq_category") != "")).alias("selected_faq"), F.round(n * F.lit(seconds) / 60, 4).alias("minutes"), F.round(n * F.lit(price), 4).alias("cost"),
    )


def crawl_counters(pages: DataFrame) -> DataFrame:
    """One row: pages fetched with success, and others."""
    ok = F.coalesce("success", F.lit(False))
    return pages.agg(F.count_if(ok).alias("crawled"), F.count_if(~ok).alias("failed"))


def coverage(df: DataFrame) -> DataFrame:
    """Per persona: records, different urls, records whose text another record has too, and records with a quick link.

    Copies are found by a hash of the text, summed before the shuffle, so equal texts never meet in one task.
    """
    hashed = df.select("persona", "url", "faq_category", F.xxhash64("text").alias("h"), F.col("text").isNotNull().alias("has"))
    copies = hashed.where("has").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(1).alias("copied"))
    joined = hashed.join(copies, "h", "left")
    return joined.groupBy("persona").agg(F.count("*").alias("records"), F.count_distinct("url").alias("urls"), F.count("copied").alias("copies"), F.count("faq_category").alias("faq"))


def run_report(kept: DataFrame, by: str = "source") -> str:
    """The merge counts as lines of text; there is one line per source."""
    rows = bounded(merge_counts(kept, by).orderBy(by), MOST_SOURCES, "sources")
    return "\n".join(f"{r[by]}: {r['kept']} kept, {r['filtered']} filtered" for r in rows)


def crawl_report(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: pages fetched and failed, section records saved, records per page, and the exit status of the run: 1 if any page failed."""
    n = sections.agg(F.count("*").alias("sections"))
    per_page = F.round(F.col("sections") / F.greatest("crawled", F.lit(1)), 4)
    return crawl_counters(pages).crossJoin(n).select("crawled", "failed", "sections", per_page.alias("per_page"), exit_status(F.col("failed")).alias("exit_status"))  # a row each


def exit_status(failed: Column) -> Column:
    """1 if any part of a run failed, else 0; a null count has not failed."""
    return F.when(F.coalesce(failed, F.lit(0)) > 0, 1).otherwise(0)


def training_report(rows: DataFrame, generated: str = "generated", price: float = 0.02) -> DataFrame:
    """One row: examples generated and skipped (null), and the estimated cost."""
    made = F.count(F.col(generated))
    return rows.agg(made.alias("generated"), (F.count("*") - made).alias("skipped"), F.round(made * F.lit(price), 2).alias("cost"))
