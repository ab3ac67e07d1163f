"""Training rows: hard negatives, prompts, parsing of generated text and chat formatting."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.strings import strip
from textloom.operators import retrieval
from textloom.rules import CHAT_TEMPLATE, SYSTEM_PROMPT

LEAST_NEGATIVE = 100
EXTRA_NEIGHBOURS = 10


def hard_negatives(oracles: DataFrame, store: DataFrame, want: int = 3, least: int = LEAST_NEGATIVE, seed: str = "pad", exclude_same_parent: bool = False, centres: np.ndarray | None = None, probes: int = 8) -> DataFrame:
    """(oracle_id, distractors): for each oracle the nearest stored texts that differ from it and are long enough.

    oracles: oracle_id, text, embedding. store: id, text, embedding, and parent if same-parent texts are excluded. The want + 10
    nearest are filtered, the first `want` kept; missing ones are padded with the texts that come first by md5 of seed and id, of
    those that are not the oracle. Without any other text an oracle has fewer. With centres (retrieval.fit_cells) only the `probes`
    nearest cells of an oracle are searched, which is what a run over all records as oracles needs; the neighbours are then
    approximate, with the recall of search_cells().
    """
    names = {"query_id": "oracle_id", "id_col": "id"}
    if centres is None:
        near = retrieval.search(oracles, store, want + EXTRA_NEIGHBOURS, **names)
    else:
        near = retrieval.search_cells(oracles, store, centres, want + EXTRA_NEIGHBOURS, probes, **names)
    own = oracles.select(F.col("oracle_id").alias("query_id"), F.col("text").alias("own_text"))
    extra = ["parent"] if exclude_same_parent else []
    texts = store.select("id", F.col("text").alias("doc"), *extra)
    ranked = near.join(texts, "id").join(own, "query_id").where((F.col("doc") != F.col("own_text")) & (F.length("doc") >= least))
    if exclude_same_parent:
        ranked = ranked.where(F.col("parent") != F.col("query_id"))
    kept = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= want)
    found = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc"))), lambda x: x["doc"]).alias("near"))
    spare = [r["text"] for r in store.where("text IS NOT NULL").orderBy(F.md5(F.concat(F.lit(seed), F.col("id").cast("string")))).select("text").limit(4 * want).collect()]  # 4 * want texts
    padded = own.join(found, "query_id", "left")
    have = F.coalesce("near", F.array().cast("array<string>"))
    pads = F.slice(F.filter(F.array(*map(F.lit, spare)).cast("array<string>"), lambda x: x != F.col("own_text")), 1, want)
    return padded.select(F.col("query_id").alias("oracle_id"), F.slice(F.concat(have, pads), 1, want).alias("distractors"))


def context_header(title: Column, section: Column, kind: Column, page: Column, persona: Column) -> Column:
    """Title, section if any, page of a PDF, and audience, a line each."""
    return F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n"), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section, F.lit("\n"))).otherwise(""),
        F.when(F.coalesce(kind, F.lit("web")) == "pdf", F.concat(F.lit("Source: PDF (Page "), F.coalesce(page.cast("string"), F.lit("unknown")), F.lit(")\n"))).otherwise(""), F.lit("Target Audience: "), F.coalesce(persona, F.lit("all")), F.lit("\n"),
    )


def distractor_text(distractors: Column, most: int = 500) -> Column:
    """Distractors numbered from 1, each cut to `most` code points and in triple quotes."""
    return F.array_join(F.transform(distractors, lambda x, i: F.concat(F.lit("\nDistractor "), (i + 1).cast("string"), F.lit(':\n"""'), F.left(x, F.lit(most)), F.lit('"""'))), "")


def generation_prompt(header: Column, oracle: Column, distractors: Column, persona: Column) -> Column:
    """A request for one question, reasoning and answer as JSON, answerable from the oracle only."""
    return F.concat(
        F.lit("Write one training example for retrieval-augmented answering. The ORACLE holds the answer, the DISTRACTORS do not.\n\nDocument metadata:\n"), header,
        F.lit('\nORACLE:\n"""'), oracle, F.lit('"""\n\nDISTRACTORS:\n'), distractor_text(distractors),
        F.lit('\n\nReturn one JSON object without code fences, with the keys "question" (what a real '), F.coalesce(persona, F.lit("all")),
        F.lit(' would ask and only the oracle answers), "thought_process" (why the oracle answers it and each distractor does not) and "answer" (short, from the oracle only).\n'),
    )


def parse_generated(output: Column) -> Column:
    """(question, thought_process, answer) of a model's output without code fences; null if that is no JSON object."""
    bare = strip(F.replace(F.replace(output, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    parsed = F.from_json(bare, "question string, thought_process string, answer string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    ok = bare.rlike(r"(?s)\A\{.*\}\z") & parsed.isNotNull() & parsed["_bad"].isNull()
    return F.when(ok, F.struct(parsed["question"].alias("question"), parsed["thought_process"].alias("thought_process"), parsed["answer"].alias("answer")))


def generate(df: DataFrame, prompt_col: str, client: Callable[[str], str | None], tries: int = 3, per_second: float | None = None, name: str = "generated", backoff: float = 5.0, rest_every: int | None = None, rest_seconds: float = 60.0) -> DataFrame:
    """df with the client's output for each prompt, null after `tries` failures. Each partition keeps its own rate, and rests for
    rest_seconds after each rest_every outputs; failures wait backoff * 2^n seconds."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = 0.0, 0
        for batch in batches:
            out = []
            for prompt in batch.column(prompt_col).to_pylist():
                text = None
                for n in range(tries if prompt is not None else 0):
                    if per_second:
                        time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                        last = time.monotonic()
                    try:
                        text = client(prompt)
                        break
                    except Exception:  # the client's failures are its own
                        if n + 1 < tries:
                            time.sleep(backoff * 2**n)
                out.append(text)
                made += text is not None
                if rest_every and text is not None and made % rest_every == 0:
                    time.sleep(rest_seconds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` string")


def training_rows(df: DataFrame) -> DataFrame:
    """Training rows of records with text, distractors and generated (question, thought_process, answer).

    source_url is the anchor_url, else the url; the page is kept for PDF only; fewer than two distractors or no generated text
    leave a record out.
    """
    kind = F.coalesce("source_type", F.lit("web"))
    kept = df.where((F.size("distractors") >= 2) & F.col("generated").isNotNull())
    return kept.select(
        F.col("generated.question").alias("question"), F.col("text").alias("oracle"), "distractors", F.col("generated.thought_process").alias("thought_process"), F.col("generated.answer").alias("answer"), F.col("text").alias("context"),
        F.coalesce("anchor_url", "url").alias("source_url"), "title", "section_header", F.coalesce("persona", F.lit("all")).alias("persona"), kind.alias("source_type"), F.when(kind == "pdf", F.col("pdf_page")).alias("pdf_page"),
    )


def chat_text(question: Column, oracle: Column, distractors: Column, thought: Column, answer: Column, system: str = SYSTEM_PROMPT, template: str = CHAT_TEMPLATE, end: str = "<|end_of_text|>", most: int = 3) -> Column:
    """A training row as one text: oracle and up to `most` distractors as numbered documents, in the chat template.

    Null distractors leave the oracle alone; other nulls read "None".
    """
    docs = F.concat(F.array(oracle), F.coalesce(F.slice(distractors, 1, most), F.array().cast("array<string>")))
    none = lambda c: F.coalesce(c, F.lit("None"))
    context = F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), none(d))), "\n\n")
    values = {"context": context, "question": none(question), "thought": none(thought), "answer": none(answer), "system": F.lit(system)}
    parts, rest = [], template
    while rest:
        marks = [(rest.index("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not marks:
            parts.append(F.lit(rest))
            break
        at, k = min(marks)
        parts += [F.lit(rest[:at]), values[k]]
        rest = rest[at + len(k) + 2 :]
    return F.concat(*parts, F.lit(end))
