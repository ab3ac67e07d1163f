"""Header sections of markdown pages, with anchors for deep links."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.strings import let, strip, totalled
from textloom.rules import LEAST_SECTION

ANCHOR = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("anchor_id", "header_text", "anchor_url", "level")]))
_HEADERS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Anchors(HTMLParser):
    """Headers with an id, in document order; their text is the stripped text nodes joined without a separator."""

    def __init__(self):
        super().__init__()
        self.found: list[list] = []
        self.open: list[tuple[str, list | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _HEADERS:
            anchor = dict(attrs).get("id")
            entry = [anchor, "", tag] if anchor else None
            if entry:
                self.found.append(entry)
            self.open.append((tag, entry))

    def handle_endtag(self, tag):
        if tag in _HEADERS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data):
        for _, entry in self.open:
            if entry:
                entry[1] += data.strip()


def anchors_of(html: str | None, url: str | None) -> list[dict]:
    if not html:
        return []
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return [{"anchor_id": a, "header_text": t, "anchor_url": f"{url or ''}#{a}", "level": h} for a, t, h in parser.found]


@F.pandas_udf(ANCHOR)
def header_anchors(html: pd.Series, url: pd.Series) -> pd.Series:
    """Anchors of each page, empty for a page without html. Broken mark-up gives what can be read."""
    return pd.Series([anchors_of(h, u) for h, u in zip(html, url)], dtype=object)


def sections(markdown: Column, anchors: Column, url: Column, least: int = LEAST_SECTION) -> Column:
    """Array of (section_header, section_content, anchor_id, anchor_url, header_level) of a page.

    With anchors, a line of one to six # and a title opens a section, and sections longer than `least` are kept; the text before
    the first header has a null header. Without anchors, or when nothing is kept, the page is one section as it is. An empty page
    has none. A section's anchor is the first one with its very title, else the page itself.
    """
    return let(markdown, lambda md: _sections(md, anchors, url, least))


def _sections(markdown: Column, anchors: Column, url: Column, least: int) -> Column:
    parts = F.split(markdown, r"(?dU)(?<![^\n])(?=#{1,6}[^\S\n]+[^\n])", -1)
    header = r"(?dU)\A(#{1,6})[^\S\n]+([^\n]+)"

    def build(part: Column) -> Column:
        title = F.when(part.rlike(header), strip(F.regexp_extract(part, header, 2)))
        mine = F.try_element_at(F.filter(anchors, lambda a: a["header_text"] == title), F.lit(1))
        return F.struct(
            title.alias("section_header"), strip(part).alias("section_content"), F.when(title.isNotNull(), mine["anchor_id"]).alias("anchor_id"),
            F.coalesce(mine["anchor_url"], url).alias("anchor_url"), F.when(title.isNotNull(), F.concat(F.lit("h"), F.length(F.regexp_extract(part, header, 1)))).alias("header_level"),
        )

    kept = F.when(F.size(anchors) > 0, F.filter(F.transform(parts, build), lambda s: F.length(s["section_content"]) > least))
    nothing = F.lit(None).cast("string")
    whole = F.array(F.struct(nothing.alias("section_header"), markdown.alias("section_content"), nothing.alias("anchor_id"), url.alias("anchor_url"), nothing.alias("header_level")))
    some = let(kept, lambda k: F.when(F.coalesce(F.size(k), F.lit(0)) > 0, k).otherwise(whole))
    return F.when(F.coalesce(F.length(markdown), F.lit(0)) > 0, some)


def section_rows(pages: DataFrame, found: Column, columns: list[str] | None = None) -> DataFrame:
    """A row per section with chunk_index, total_chunks and the given columns of the page, all by default."""
    columns = pages.columns if columns is None else columns
    rows = pages.select(*columns, F.posexplode(totalled(found, "section")).alias("chunk_index", "_one"))
    return rows.select(*columns, "chunk_index", F.col("_one.total").alias("total_chunks"), "_one.section.*")
