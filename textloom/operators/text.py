"""Cleaning of web and PDF text. Null texts stay null; empty texts stay empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.strings import PDF_FLAGS, WEB_FLAGS, let, remove_all, split_lines, strip
from textloom.rules import DEFAULT_SITE, Site, pdf_noise, web_boilerplate


def remove_web_boilerplate(text: Column, site: Site = DEFAULT_SITE) -> Column:
    """text without each boilerplate pattern, in order. Two patterns run to the end of the text."""
    return remove_all(text, web_boilerplate(site), WEB_FLAGS)


def normalise_lines(text: Column) -> Column:
    """text without blank lines and without lines that repeat the one before, compared without white space at the ends.

    Blank lines between two equal lines do not keep them apart; kept lines keep their white space; the result is stripped.
    """
    pairs = F.filter(F.transform(split_lines(text), lambda x: F.struct(x.alias("raw"), strip(x).alias("bare"))), lambda p: p["bare"] != "")

    def kept(lines: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(lines["bare"], F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))
        return F.array_compact(F.zip_with(lines, before, lambda p, b: F.when(p["bare"] != b, p["raw"])))

    return strip(F.array_join(let(pairs, kept), "\n"))


def clean_web(text: Column, site: Site = DEFAULT_SITE) -> Column:
    """Web text: boilerplate removed, lines normalised. Null becomes empty, as an absent page has no text."""
    return normalise_lines(remove_web_boilerplate(F.coalesce(text, F.lit("")), site))


def remove_pdf_noise(text: Column, site: Site = DEFAULT_SITE) -> Column:
    return remove_all(text, pdf_noise(site), PDF_FLAGS)


def collapse(text: Column) -> Column:
    """Three and more line feeds become two, two and more blanks one."""
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), " {2,}", " ")


# Digits that are no decimals, such as superscripts and circled ones; the rule is Python's own, so that both agree.
OTHER_DIGITS = "".join(chr(c) for c in range(0x110000) if chr(c).isdigit() and not chr(c).isdecimal())


def drop_page_numbers(text: Column) -> Column:
    """text without lines of up to three digits, then stripped. Superscripts and the like are digits too."""
    return strip(F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~strip(x).rlike(rf"(?U)\A[\d{OTHER_DIGITS}]{{1,3}}\z")), "\n"))


def clean_pdf(text: Column, site: Site = DEFAULT_SITE) -> Column:
    """PDF text: noise removed, blanks collapsed, page numbers dropped. Null stays null."""
    return drop_page_numbers(collapse(remove_pdf_noise(text, site)))


def page_text(blocks: Column) -> Column:
    """Text of a PDF page's layout tree: spans of text blocks (type 0), joined with one blank."""
    spans = F.transform(F.filter(blocks, lambda b: b["type"] == 0), lambda b: F.flatten(F.transform(b["lines"], lambda x: F.transform(x["spans"], lambda s: s["text"]))))
    return F.array_join(F.flatten(spans), " ")
