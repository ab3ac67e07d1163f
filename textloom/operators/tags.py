"""Tags from urls and questions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import first_containing
from textloom.rules import DEFAULT_SITE, QUERY_PERSONAS, Site, persona_rules
from textloom.session import bounded

MOST_QUICK_LINKS = 1_000  # literals of one expression; more are an error


def persona(url: Column, site: Site = DEFAULT_SITE) -> Column:
    """Persona of a page: the first rule with a pattern in the lower-cased url, else "all". A null url is "all"."""
    return first_containing(F.lower(url), persona_rules(site), "all")


def query_persona(question: Column, rules: Iterable[tuple[str, list[str]]] = tuple(QUERY_PERSONAS)) -> Column:
    """Persona that a question names, else null."""
    return first_containing(F.lower(question), rules, None)


def quick_link_category(pages: DataFrame, quick_links: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with faq_category: of the quick links whose url is part of the page's url, the first by faq_ix; null if none.

    Quick links are a dimension with a few rows; they become ordered literals, so the pages are neither shuffled nor joined.
    """
    rows = quick_links.select("faq_ix", "category", "url").where("url IS NOT NULL AND url <> ''").orderBy("faq_ix")
    rules = [(r["category"], [r["url"]]) for r in bounded(rows, MOST_QUICK_LINKS, "quick links")]
    return pages.withColumn("faq_category", first_containing(F.col(url_col), rules, None))


def persona_allows(column: Column, wanted: str, mode: str = "exact") -> Column:
    """Whether a row may answer a persona: its own or "all". "all" lets every row through.

    In mode "exact" a comma list of personas never equals a single one; mode "split" looks into the list.
    """
    if mode not in ("exact", "split"):
        raise ValueError("mode is exact or split")
    if wanted == "all":
        return F.lit(True)
    if mode == "exact":
        return F.coalesce(column.isin(wanted, "all"), F.lit(False))
    parts = F.transform(F.split(column, ","), F.trim)
    return F.coalesce(F.array_contains(parts, wanted) | F.array_contains(parts, "all"), F.lit(False))
