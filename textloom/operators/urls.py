"""URLs, links and reachability."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.strings import contains_any
from textloom.rules import DEFAULT_SITE, IGNORED_EXTENSIONS, Site
from textloom.schemas import PAGE
from textloom.session import cut


def authority(url: Column) -> Column:
    """User, host and port as written, also of a url without a scheme (//host/path); empty where there is none."""
    return F.regexp_extract(url, r"\A(?:[^:/?#]+:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def admitted(url: Column, site: Site = DEFAULT_SITE) -> Column:
    """Whether a url may be crawled: its authority holds an allowed domain, its path has no ignored extension, and it has no fragment.

    Domains are compared as substrings and in their case, so look-alike hosts pass. Null urls are not admitted.
    """
    extension = F.lower(path(url)).rlike(r"\.(?:" + "|".join(IGNORED_EXTENSIONS) + r")\z")
    return F.coalesce(contains_any(authority(url), site.allowed) & ~extension & ~F.contains(url, F.lit("#")), F.lit(False))


def defragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def page_link(url: Column, page: Column) -> Column:
    """Deep link to a page of a PDF: the url without fragment and query, and #page=n."""
    return F.concat(F.split_part(defragment(url), F.lit("?"), F.lit(1)), F.lit("#page="), page.cast("string"))


def hrefs(html: Column) -> Column:
    """Targets of the links of well-formed html, in document order; empty for null html."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"'), 1)
    return F.coalesce(found, F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
    """RFC 3986 resolution of a link; null if either is null, the link itself if it can't be resolved."""

    def one(b, x):
        if b is None or x is None:
            return None
        try:
            return urljoin(b, x)
        except ValueError:
            return x

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, link_ix, href, target): links of each page; target is absolute and has no fragment."""
    one = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.posexplode(hrefs(F.col(html_col))).alias("link_ix", "href"))
    return one.withColumn("target", defragment(absolute("url", "href")))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], most_pages: int, site: Site = DEFAULT_SITE, most_rounds: int = 1000) -> DataFrame:
    """(url, html, markdown, success, metadata, place): pages fetched from a first-in-first-out queue of urls until it is empty or
    most_pages pages had success.

    seeds: url, place (a number; the order of the queue). fetch turns (url) into (url, html, markdown, success, metadata), a row per
    url. A url counts as seen from the time it is queued; a failed page uses no budget and gives no links; a page with success gives
    its links, however short its text. Links are made absolute, cut at the fragment, and queued if they are admitted and new, in the
    order of pages and links. place orders the pages: (round, number).

    Each round fetches the whole queue, or as much of it as budget is left, so that the budget is never passed.
    """
    queue = cut(seeds.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct(F.lit(0).alias("round"), F.col("place").cast("long").alias("number"))).alias("place")))
    seen = queue.select("url")
    done: DataFrame | None = None
    left = most_pages
    for step in range(1, most_rounds + 1):
        waiting = queue.count()
        if not waiting or left <= 0:
            break
        now = queue if waiting <= left else cut(queue.orderBy("place").limit(left))  # as many as the budget allows
        later = None if waiting <= left else queue.join(now.select("url"), "url", "left_anti")
        pages = cut(fetch(now.select("url")).select("url", "html", "markdown", F.coalesce("success", F.lit(False)).alias("success"), "metadata").join(now, "url"))
        left -= pages.where("success").count()
        done = pages if done is None else done.unionByName(pages)
        found = links(pages.where("success"), "place").where(admitted(F.col("target"), site))
        first = found.groupBy(F.col("target").alias("url")).agg(F.min(F.struct("id", "link_ix")).alias("_at")).join(seen, "url", "left_anti")
        placed = first.orderBy("_at").select("url", F.struct(F.lit(step).alias("round"), F.monotonically_increasing_id().alias("number")).alias("place"))
        new = cut(placed)
        seen = cut(seen.unionByName(new.select("url")))
        queue = new if later is None else cut(later.unionByName(new))
    else:
        raise RuntimeError("urls are left after most_rounds rounds; raise it")
    spark = seeds.sparkSession
    return done if done is not None else spark.createDataFrame([], f"{PAGE}, place struct<round:int,number:bigint>")


def reachable(edges: DataFrame, seeds: DataFrame, most_levels: int = 1000, most_pages: int | None = None) -> DataFrame:
    """(url, depth): pages reached from the seeds over edges (src, dst), breadth first until nothing is new.

    A page counts once, at its smallest depth. Each level is an anti-join with the visited pages, cut in the shared folder. With
    most_pages the crawl stops after the level that reaches it, and of that level the first urls in order fill the budget. A graph
    with more than most_levels levels is an error, as the result would be cut short.
    """
    step = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct())
    visited = cut(seeds.select(F.col("url")).where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, most_levels + 1):
        new = step.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = cut(new.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        if most_pages is not None:
            left = most_pages - visited.count()
            if frontier.count() >= left:
                return visited.unionByName(frontier.orderBy("url").limit(max(left, 0)))
        visited = cut(visited.unionByName(frontier))
    else:
        raise RuntimeError("pages are left after most_levels levels; raise it")
    return visited
