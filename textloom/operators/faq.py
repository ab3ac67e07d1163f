"""Quick links: questions matched with keywords."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.rules import QUICK_LINK_THRESHOLD
from textloom.session import bounded

MOST_KEYWORDS = 10_000  # of the dimension of quick links; more are an error


def keyword_table(quick_links: DataFrame) -> list[tuple]:
    """(faq_ix, category, kw_ix, keyword) of a dimension of a few rows, in order."""
    rows = quick_links.select("faq_ix", "category", F.posexplode("keywords").alias("kw_ix", "keyword")).where("keyword IS NOT NULL AND keyword <> ''").orderBy("faq_ix", "kw_ix")
    return [tuple(r) for r in bounded(rows, MOST_KEYWORDS, "keywords of quick links")]


def match(questions: DataFrame, quick_links: DataFrame, question_col: str = "question", threshold: float = QUICK_LINK_THRESHOLD) -> DataFrame:
    """questions that match a quick link, with category, keyword and confidence.

    A keyword that the lower-cased question holds scores its share of the question's length, and 0.3 more as a whole word, at the
    start or at the end. Keywords are tried in order; one replaces the best so far if its score is higher than that one's, which is
    capped at 1. So the last score above 1 wins where there is one, else the first of the highest. The score must reach the
    threshold. Null questions match nothing. Keywords are literals of one narrow expression: no join.
    """
    low = F.lower(F.col(question_col))
    best = None
    for place, (_, category, _, keyword) in enumerate(keyword_table(quick_links)):
        whole = F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(f" {keyword} ")) | F.startswith(low, F.lit(keyword)) | F.endswith(low, F.lit(keyword))
        score = F.lit(float(len(keyword))) / F.greatest(F.length(low), F.lit(len(keyword))) + F.when(whole, 0.3).otherwise(0.0)
        order = F.when(score > 1.0, F.lit(place)).otherwise(F.lit(-place))
        one = F.when(F.contains(low, F.lit(keyword)), F.struct((score > 1.0).alias("over"), F.least(score, F.lit(1.0)).alias("score"), order.alias("order"), F.lit(category).alias("category"), F.lit(keyword).alias("keyword")))
        best = [one] if best is None else [*best, one]
    if not best:
        return questions.limit(0).select("*", F.lit("").alias("category"), F.lit("").alias("keyword"), F.lit(0.0).alias("confidence"))
    top = F.array_max(F.array_compact(F.array(*best)))
    found = questions.withColumn("_m", top).where(F.col("_m").isNotNull() & (F.col("_m.score") >= threshold))
    return found.select(*questions.columns, F.col("_m.category").alias("category"), F.col("_m.keyword").alias("keyword"), F.col("_m.score").alias("confidence"))


def answer(description: Column, title: Column, url: Column, confidence: Column) -> Column:
    """The answer with a quick link; the confidence as a whole percentage, halves to even."""
    percent = F.concat(F.bround(confidence * 100).cast("int").cast("string"), F.lit("%"))
    return F.concat(F.lit("**Quick Answer:**\n\n"), description, F.lit("\n\n**[Visit "), title, F.lit("]("), url, F.lit(")**\n\n*This is a high-confidence direct link (confidence: "), percent, F.lit(")*\n"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-cased texts; null if either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)], dtype="float64")
