"""Assembly of records: web sections, PDF chunks, the combined corpus, and chunks for the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import let, strip
from textloom.operators import quality, sections, tags, text, urls
from textloom.operators.chunk import boundary_chunks, explode_chunks, gated_chunks
from textloom.rules import DEFAULT_SITE, Site


def web_sections(pages: DataFrame, quick_links: DataFrame | None = None, site: Site = DEFAULT_SITE) -> DataFrame:
    """Section records of crawled pages: cleaned, long enough, split at headers, tagged.

    Pages without success or text give none. A title that is missing from the metadata is "No Title", a time "".
    """
    ok = pages.where(F.coalesce("success", F.lit(False))).select("url", "metadata", "markdown", sections.header_anchors("html", "url").alias("_anchors"))
    found = let(text.clean_web(F.col("markdown"), site), lambda md: F.when(quality.page_long_enough(md), sections.sections(md, F.col("_anchors"), F.col("url"))))
    rows = sections.section_rows(ok, found, ["url", "metadata"])
    out = rows.select(
        metadata_value(F.col("metadata"), "title", "No Title").alias("title"), "section_header", F.col("section_content").alias("text"), "url", "anchor_url", "anchor_id", "header_level",
        tags.persona(F.col("url"), site).alias("persona"), F.lit(None).cast("string").alias("faq_category"), "chunk_index", "total_chunks", metadata_value(F.col("metadata"), "scraped_at", "").alias("page_scraped_at"),
    )
    return tags.quick_link_category(out, quick_links) if quick_links is not None else out


def metadata_value(metadata: Column, key: str, default: str) -> Column:
    """A value of a map; the default applies only where the key is absent, a null value stays null."""
    return F.when(F.coalesce(F.map_contains_key(metadata, key), F.lit(False)), metadata[key]).otherwise(F.lit(default))


def pdf_chunks(pages: DataFrame, site: Site = DEFAULT_SITE, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunk records of PDF pages (pdf_key, url, title, persona, priority, pdf_filename, total_pages, page_no from 0, text).

    Pages are cleaned and chunked one by one; short ones are left out. A null persona is "all", a null priority "medium".
    """
    found = let(text.clean_pdf(F.col("text"), site), lambda t: F.when(quality.pdf_page_long_enough(t), boundary_chunks(t, size, overlap)))
    rows = explode_chunks(pages, found, "chunk_index", "total_chunks_on_page", "_piece").drop("text").withColumnRenamed("_piece", "text")
    n = F.col("page_no") + 1
    return rows.select(
        "title", F.concat(F.lit("Page "), n).alias("section_header"), "text", "url", urls.page_link(F.col("url"), n).alias("anchor_url"), F.concat(F.lit("page-"), n).alias("anchor_id"), F.lit(None).cast("string").alias("header_level"),
        F.lit("pdf").alias("source_type"), n.cast("int").alias("pdf_page"), "total_pages", "chunk_index", "total_chunks_on_page", F.coalesce("persona", F.lit("all")).alias("persona"), F.lit(None).cast("string").alias("faq_category"),
        F.coalesce("priority", F.lit("medium")).alias("priority"), "pdf_key", "pdf_filename",
    )


def combine(web: DataFrame, pdf: DataFrame, drop_error_pages: bool = True) -> DataFrame:
    """Web and PDF records by name, nothing de-duplicated, error pages left out."""
    both = web.unionByName(pdf, allowMissingColumns=True)
    return both.where(~quality.error_page(F.col("title"), F.col("text"))) if drop_error_pages else both


def with_defaults(df: DataFrame) -> DataFrame:
    """Records as the index stores them: null header and level as "", null page as 0, anchor_url as url, source_type as web, persona as all."""
    return df.withColumns(
        {
            "anchor_url": F.coalesce("anchor_url", "url"), "persona": F.coalesce("persona", F.lit("all")), "source_type": F.coalesce("source_type", F.lit("web")),
            "section_header": F.coalesce("section_header", F.lit("")), "header_level": F.coalesce("header_level", F.lit("")), "pdf_page": F.coalesce("pdf_page", F.lit(0)),
        }
    )


def index_chunks(df: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks for the index with metadata and a key from url, section and chunk, so that a second run replaces its rows.

    Records without text give none; texts up to size are one chunk.
    """
    kept = with_defaults(df.where(quality.has_text(F.col("text"))))
    rows = kept.withColumn("_c", gated_chunks(F.col("text"), size, overlap)).select("url", "anchor_url", "title", "section_header", "persona", "source_type", "header_level", "pdf_page", "chunk_index", F.posexplode("_c").alias("chunk_ix", "document"))
    key = F.sha2(F.concat_ws("|", "url", "section_header", F.col("pdf_page").cast("string"), F.col("chunk_index").cast("string"), F.col("chunk_ix").cast("string"), F.md5("document")), 256)
    return rows.select(key.alias("chunk_id"), "chunk_ix", "document", "url", "anchor_url", "title", "section_header", "persona", "source_type", "header_level", "pdf_page")


def requests(df: DataFrame, least: int = 1, most: int = 1000) -> DataFrame:
    """Requests whose question has a valid length before and any text after stripping; the question is stripped."""
    valid = df.where(F.coalesce(F.length("question").between(least, most), F.lit(False)))
    return valid.withColumn("question", strip(F.col("question"))).where("question <> ''")
