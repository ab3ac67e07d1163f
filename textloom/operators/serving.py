"""What a service does with questions and answers, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.strings import strip
from textloom.operators.chunk import slices

DEFAULT_TITLE = "University Resource"
EXIT_WORDS = ("exit", "quit", "q")


def sources(answer: Column) -> Column:
    """Array of (url, title) of an answer's lines with "http", one per line at most; null if there are none.

    The url runs from the first "http" to the next one or the first ")", stripped; the title is the text before without "Source:".
    """
    lines = F.filter(F.split(answer, "\n", -1), lambda x: F.contains(x, F.lit("http")))

    def one(x: Column) -> Column:
        url = F.concat(F.lit("http"), strip(F.split_part(F.split_part(x, F.lit("http"), F.lit(2)), F.lit(")"), F.lit(1))))
        title = strip(F.replace(F.split_part(x, F.lit("http"), F.lit(1)), F.lit("Source:"), F.lit("")))
        return F.struct(url.alias("url"), F.when(title == "", F.lit(DEFAULT_TITLE)).otherwise(title).alias("title"))

    return F.when(F.size(lines) > 0, F.transform(lines, one))


def with_elapsed(metadata: Column, seconds: Column) -> Column:
    """metadata with processing_time, rounded to two places; a null map is created, an old value replaced."""
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != "processing_time")
    return F.map_concat(base, F.create_map(F.lit("processing_time"), F.round(seconds, 2).cast("string")))


def stream_events(df: DataFrame, id_col: str, answer_col: str) -> DataFrame:
    """(id, seq, event, data): a start event, the answer in slices of 50, and complete, or error where the answer is null."""
    begin = F.array(F.struct(F.lit("start").alias("event"), F.lit("").alias("data")))
    body = F.transform(slices(F.col(answer_col)), lambda s: F.struct(F.lit("chunk").alias("event"), s.alias("data")))
    done = F.array(F.struct(F.lit("complete").alias("event"), F.lit("").alias("data")))
    failed = F.array(F.struct(F.lit("error").alias("event"), F.lit("no answer").alias("data")))
    events = F.when(F.col(answer_col).isNull(), F.concat(begin, failed)).otherwise(F.concat(begin, body, done))
    return df.select(F.col(id_col).alias("id"), F.posexplode(events).alias("seq", "_e")).select("id", "seq", "_e.event", "_e.data")


def until_exit(questions: DataFrame, session_col: str, order_col: str, question_col: str = "question") -> DataFrame:
    """Questions of each session before its first exit word; the exit itself is left out.

    The first exit is an aggregate per session, joined back: sessions are never gathered in one task.
    """
    leaves = F.lower(strip(F.col(question_col))).isin(*EXIT_WORDS)
    first = questions.where(leaves).groupBy(F.col(session_col).alias("_session")).agg(F.min(order_col).alias("_stop"))
    joined = questions.join(first, F.col(session_col).eqNullSafe(F.col("_session")), "left")
    return joined.where(F.col("_stop").isNull() | (F.col(order_col) < F.col("_stop"))).drop("_session", "_stop")


def command(prefix: Column, commands: list[str]) -> Column:
    """The first command that starts with a prefix, null for none."""
    out = F.lit(None).cast("string")
    for c in reversed(commands):
        out = F.when(F.startswith(F.lit(c), prefix), c).otherwise(out)
    return out


def append_messages(history: DataFrame, new: DataFrame) -> DataFrame:
    """history (role, content, sources) with new messages below."""
    return history.unionByName(new, allowMissingColumns=True)
