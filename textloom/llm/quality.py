"""Problem 4: text statistics of every row, and the rows that are not prose.

Statistics are quantised to a bounded number of values; their exact ranks, per language and over different texts, come from
range-partitioned sorting of the counted values with partition offsets. Among the statistics are the shares of the main body whose
lines look like a list, a table or junk. The outlier score of a kind is the empirical upper tail of its share, as -log10, and a part of
how far the other statistics together lie in their two-sided tails. A row is a case of the kind with the highest score over its bar,
the score of a share of a half in the same distribution.

Ranks are over different texts, so that a text that is delivered again, even as a third of all rows, is as much of an outlier as once.

Defined cases: null texts have null statistics and no case; empty and blank texts have zeros; rows of equal values share ranks;
a language without evidence ("und") is ranked among all rows; rows with a case of problem 7, and texts under 5 words that are not
junk, have no kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import mainbody, residue, tokens
from textloom.llm.languages import FUNCTION_WORDS, OF_WORD, WEIGHT
from textloom.llm.ranks import running

STATS = ("words", "word_length", "symbol_ratio", "stop_line_share", "common_share", "digit_ratio", "odd_share")
KINDS = ("junk", "table", "list")
SHARES = tuple(f"{k}_share" for k in KINDS)
CONTEXT = 0.1  # weight of the other statistics in the score of a kind
TYPICAL = 0.4343  # mean of -log10 of a uniform tail probability
LEAST_SHARE = 0.4  # of the main body that a kind must have, whatever its score
MOST_WORD_LENGTH = 50.0

WORD = re.compile(r"[^\W_]+")
STOP = re.compile(r"[.!?…:;。][\"'”’)\]]*$")
CODE = re.compile(r"[{};]\s*$|^\s*(?:var|let|const|function|def|class|import|return|if|for|while|public|private|#include|select|insert)\b.*[({;:=]|^\s*[.#@]?[\w\-]+\s*\{.*\}?|=>|\);|&&|\|\||</?(?:script|style)|^\s*(?://|/\*)")
BLOB = re.compile(r"(?<![\w/:.\-@])(?=[A-Za-z0-9+/=]*\d)[A-Za-z0-9+/=]{24,}(?![\w.])|\b[0-9a-f]{20,}\b")
BAD_WORD = re.compile(r"^[^aeiouyáéíóúàâêôäöüãõAEIOUY\W\d_]{3,}$|[bcdfghjklmnpqrstvwxz]{5,}", re.I)
MOJIBAKE = re.compile("Ã[\x80-\xbfƒ‚ -¿]|Â[\x80-\xbf -¿]|â€|�|Ãƒ|ï»¿|Ã.")
RUN = re.compile(r"([^\s.\-_=*~#])\1{7,}")
GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
CSV = re.compile(r"[^\s,],(?=[^\s,])|,,")
NUMBER = re.compile(r"^[$€£+\-]?\d[\d.,:/%\-]*[%$€]?$")
KEY_VALUE = re.compile(r"^[^:]{2,60}:\s+[$€£]?\d[\d.,%\-/:]*\s*\S{0,8}$|^[A-Za-z][\w ]{1,30}\s?[:=]\s?\S+(?: \S+){0,3}$")
LEADER = re.compile(r"\.{4,}\s*\d+\s*$|(?: \.){4,}\s*\d+\s*$|_{4,}\s*\d+\s*$")
BULLET = re.compile(r"^\s*(?:[-*•‣·▪–☐☑✓✔]|\d{1,3}[.)]|\(?[a-z]{1,2}[.)]|\[[ x]\])\s+", re.I)


LONG_FUNCTION_WORDS = {w for w in OF_WORD if len(w) > 1}


LONG_TOKEN, ONE_LETTER_SHARE, LONG_FUNCTION_SHARE = 20, 0.6, 0.2
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def plain(lines: mainbody.Lines) -> np.ndarray:
    """Which lines are prose that no rule of line_kind() gives another kind: a cheap bound on each of them, for whole batches."""
    if not len(lines.row):
        return np.zeros(0, bool)
    col = lambda c: lines.base[:, mainbody.COL[c]]
    s, words = lines.text, lines.words
    count = lambda what: pc.count_substring(s, what).to_numpy(zero_copy_only=False)
    solid = ~_BLANKS[words.data]
    change = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    start, size = change[0::2], change[1::2] - change[0::2]
    of = np.searchsorted(words.offsets, start, side="right") - 1
    tokens_ = np.bincount(of, minlength=len(s))
    single = np.bincount(of, size == 1, minlength=len(s))
    longest = np.zeros(len(s), np.int64)
    np.maximum.at(longest, of, size)
    dense = np.bincount(of, size, minlength=len(s))
    letters = mainbody._per_line(words, words.end - words.start)
    function = mainbody._per_line(words, (lines.known & mainbody._LONG_FUNCTION) > 0)
    n = col("words")
    ok = (n >= 8) & (function >= LONG_FUNCTION_SHARE * n) & (single < ONE_LETTER_SHARE * tokens_) & (longest < LONG_TOKEN) & (dense - letters <= 0.45 * dense)
    ok &= 2 * col("digit_share") * col("chars") < tokens_
    ok &= np.asarray(pc.match_substring_regex(s, r"^[A-Za-z][A-Za-z](?:[^.)]|$)")) & np.asarray(pc.string_is_ascii(s))
    for what in ("|", "\t", "<", "](", ";", "..", ". .", "__", "  "):
        ok &= count(what) == 0
    return ok & (count(",") - count(", ") < 3)


def line_kind(line: str) -> str:
    """"prose", "list", "table" or "junk" of a non-blank line that is no heading and no furniture."""
    s = line.strip()
    low = WORD.findall(s.lower())
    n = len(low)
    function = sum(map(OF_WORD.__contains__, low))
    dense = len(s) - s.count(" ") or 1
    symbols = max(0, dense - s.count("\t") - sum(map(len, low)))
    if not s.isascii() and len(MOJIBAKE.findall(s)) >= 2:
        return "junk"
    if LEADER.search(s):
        return "list"
    tokens = s.split()
    if len(tokens) >= 10:
        single = [x for x in tokens if len(x) == 1]
        if len(single) >= 0.6 * len(tokens) and sum(map(str.isalpha, single)) >= 0.5 * len(single):
            return "junk"
    if s[:1] == "|" and s.count("|") >= 2 or s.count(" | ") >= 2 or "<td" in s or "<tr" in s or "</t" in s:
        return "table"
    links = mainbody.LINK.findall(s) if "](" in s else ()
    if links and sum(len(a) + len(b) + 4 for a, b in links) >= 0.6 * len(s):
        return "list"
    if n == 0 and len(s) < 6:
        return "prose"
    if symbols > 0.45 * dense and len(s) > 5:
        return "junk" if len(set(s)) > 3 else "table"
    if BLOB.search(s) and sum(len(x) for x in tokens if BLOB.search(x)) > 0.5 * dense:
        return "junk"
    if sum(map(LONG_FUNCTION_WORDS.__contains__, low)) < 0.15 * n and CODE.search(s) and symbols > 0.12 * dense:
        return "junk"
    bad = sum(1 for w in low if BAD_WORD.search(w))
    if n >= 4 and bad >= 0.4 * n and function < 0.2 * n:
        return "junk"
    if RUN.search(s) and function < 0.2 * max(n, 1):
        return "junk"
    bullet = BULLET.match(s)
    if not bullet:
        if s.count("\t") >= 2 or len(CSV.findall(s)) >= 3 and function < 0.3 * n:
            return "table"
        numbers = sum(1 for x in tokens if NUMBER.match(x))
        if len(tokens) >= 3 and numbers >= 0.5 * len(tokens):
            return "table"
        if len(tokens) >= 3 and len(GAPS.findall(s)) >= 2 and function < 0.3 * n and len(tokens) <= 12:
            return "table"
        if n <= 10 and function <= 1 and KEY_VALUE.match(s):
            return "table"
    if s.count(";") >= 3 and function < 0.1 * n and sum(1 for x in s.split(";") if len(x.split()) <= 4) >= 0.8 * (s.count(";") + 1):
        return "list"
    if bullet:
        return "list"
    if function >= 2 and n >= 6:
        return "prose"
    if n <= 7 and not STOP.search(s):
        return "list"
    if n >= 12 and function < 0.04 * n:  # items where something parts them, else words heaped up at random
        return "list" if 6 * sum(map(s.count, (",", ";", "|", "•", "·", "/", " - "))) >= n else "junk"
    return "prose"


class Odd:
    """Which words are odd: of one letter, very long, or hard to speak. Verdicts are kept by hash, up to a bound."""

    def __init__(self):
        self.known: dict[int, bool] = {}

    def __call__(self, words: tokens.Words) -> np.ndarray:
        if not len(words.hash):
            return np.zeros(0, bool)
        different, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.known) > 500_000:
            self.known.clear()
        out = np.empty(len(different), bool)
        for k, (h, at) in enumerate(zip(different.tolist(), first.tolist())):
            verdict = self.known.get(h)
            if verdict is None:
                w = words.data[words.start[at] : words.end[at]].tobytes().decode()
                verdict = self.known[h] = len(w) == 1 or len(w) > 24 or BAD_WORD.search(w) is not None
            out[k] = verdict
        return out[back]


_LANGUAGES = tuple(sorted(FUNCTION_WORDS, reverse=True))
_COMMON = mainbody.Vocabulary({w: 1 + k for k, w in enumerate(OF_WORD)})
_WEIGHTS = np.array([[0.0] * len(_LANGUAGES)] + [[WEIGHT[w] * (lang in OF_WORD[w]) for lang in _LANGUAGES] for w in OF_WORD])
_IN = (_WEIGHTS > 0).astype(float)


def significant(x: np.ndarray, digits: int = 3) -> np.ndarray:
    """x rounded to so many significant digits."""
    scale = 10.0 ** np.maximum(np.floor(np.log10(np.maximum(x, 1))) - digits + 1, 0)
    return np.round(x / scale) * scale


def statistics(lines: mainbody.Lines, texts: list[str | None], odd: Odd) -> tuple[np.ndarray, np.ndarray]:
    """(language, quantised STATS) of each text, from its non-blank lines. The language is the one with the most function words."""
    rows = len(texts)
    words, row = lines.words, lines.row
    of = row[words.doc] if len(row) else np.zeros(0, np.int64)
    total = lambda values, by=row: np.bincount(by, values, minlength=rows)
    col = lambda c: lines.base[:, mainbody.COL[c]]
    n = total(col("words"))
    common = _COMMON(words.hash)
    at = np.flatnonzero(common)
    found = np.stack([total(_WEIGHTS[common[at], k], of[at]) for k in range(len(_LANGUAGES))], axis=1)
    share = np.stack([total(_IN[common[at], k], of[at]) for k in range(len(_LANGUAGES))], axis=1)
    best = found.argmax(axis=1)
    top = found[np.arange(rows), best]
    sure = (top >= 2) & (top >= 0.03 * n)
    language = np.where(sure, np.array(_LANGUAGES)[best], "und")
    tails = np.concatenate(([0], np.cumsum((words.data & 0xC0) == 0x80)))  # bytes of a character after its first
    letters = total(words.end - words.start - (tails[words.end] - tails[words.start]), of)
    data, offsets = tokens.raw(lines.text)
    dense = total(col("chars") - mainbody.byte_counts(data, offsets, _BLANKS))
    stop = np.asarray(pc.match_substring_regex(pc.utf8_slice_codeunits(lines.text, -8, 1 << 30), STOP.pattern).to_numpy(zero_copy_only=False), float) if len(row) else np.zeros(0)
    strange = total(odd(words), of)
    for i, text in enumerate(texts):
        if text and not text.isascii():
            strange[i] += len(MOJIBAKE.findall(text))
    digits = total(np.round(col("digit_share") * col("chars")))
    over = lambda a, b: np.divide(a, b, out=np.zeros(rows), where=b > 0)
    hits = np.where(sure, share[np.arange(rows), best], total(common > 0, of))
    return language, np.column_stack(
        (significant(n), np.minimum(np.round(over(letters, n), 2), MOST_WORD_LENGTH), np.round(np.clip(over(dense - letters, dense), 0, 1), 4), np.round(over(total(stop), total(np.ones(len(row)))), 4), np.round(over(hits, n), 4), np.round(over(digits, dense), 4), np.round(np.minimum(1, over(strange, n)), 3))
    )


def body_shares(lines: mainbody.Lines, furniture: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares of each row's main body by KINDS, words of the body). Headings weigh nothing; a body of a few words, over and over,
    is junk as a whole."""
    kept = ~furniture & (lines.base[:, mainbody.COL["heading"]] == 0)
    kind = np.full(len(kept), -1)
    text = lines.text
    for i in np.flatnonzero(kept & ~plain(lines)).tolist():
        kind[i] = KINDS_OF[line_kind(text[i].as_py())]
    weight = np.where(kept, lines.base[:, mainbody.COL["chars"]], 0.0)
    total = np.bincount(lines.row, weight, minlength=rows)
    shares = np.stack([np.bincount(lines.row, weight * (kind == k), minlength=rows) for k in range(len(KINDS))], axis=1)
    shares = np.divide(shares, total[:, None], out=np.zeros_like(shares), where=total[:, None] > 0)
    words = lines.words
    mine = kept[words.doc] if len(kept) else np.zeros(0, bool)
    of = lines.row[words.doc[mine]] if len(kept) else np.zeros(0, np.int64)
    n = np.bincount(of, minlength=rows)
    order = np.lexsort((words.hash[mine], of))
    of, h = of[order], words.hash[mine][order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1]))) if len(of) else np.zeros(0, bool)
    different = np.bincount(of[new], minlength=rows)
    repeated = (n >= 12) & (different <= np.maximum(6, 0.12 * n)) & (different <= 0.34 * n)
    shares[repeated] = np.array([k == "junk" for k in KINDS], float)
    every = np.bincount(lines.row[words.doc], weights=(~furniture)[words.doc], minlength=rows) if len(kept) else np.zeros(rows)
    return np.round(shares, 3), every


KINDS_OF = {"prose": -1, **{k: i for i, k in enumerate(KINDS)}}


def profile(rows: DataFrame, model: mainbody.Model | None, id_col: str = "rec_id", text_col: str = "text", title_col: str = "title", url_col: str = "url", kind_col: str = "source_type") -> DataFrame:
    """(id, text_hash, language, STATS, SHARES): narrow. Shares are zero where problem 7 has a case, and lists and tables of less than
    5 words have none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = Odd()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts, urls, web = (batch.column(c).to_pylist() for c in ("t", "u", "web"))
                lines = mainbody.Lines.of(texts, urls)
                furniture = np.zeros(len(lines.row), bool)
                if shared.value is not None:
                    asked = np.array(web, bool)[lines.row] if len(lines.row) else furniture
                    furniture[asked] = mainbody.predict(shared.value, lines.some(asked))
                language, values = statistics(lines, texts, odd)
                shares, words = body_shares(lines, furniture, len(texts))
                shares[:, [KINDS.index("list"), KINDS.index("table")]] *= (words >= 5)[:, None]
                some = np.flatnonzero(shares.max(axis=1) >= LEAST_SHARE)
                if len(some):
                    taken = batch.take(pa.array(some))
                    case = residue.cases(taken.column("h"), taken.column("t"))
                    shares[some[[bool(c) or residue.is_filler(t, 0.6) for c, t in zip(case, taken.column("t").to_pylist())]]] = 0
                null = np.array([t is None for t in texts], bool)
                columns = [pa.array(v, mask=null) for v in (*values.T, *shares.T)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(language, pa.string(), mask=null), *columns], ["id", "text_hash", "language", *STATS, *SHARES])

    string = lambda c: F.col(c).cast("string")
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(string(text_col)).alias("x"), string(text_col).alias("t"), string(title_col).alias("h"), string(url_col).alias("u"), (F.coalesce(F.lower(F.trim(string(kind_col))), F.lit("")) != "pdf").alias("web"))
    return picked.mapInArrow(run, "id long, text_hash long, language string, " + ", ".join(f"{s} double" for s in (*STATS, *SHARES)))


def ecdf(profiled: DataFrame) -> DataFrame:
    """(language, stat, value, n, before, total): exact counts of each value and of those before it over different texts, per language
    and for all ("und"). Values are quantised: at most some 60,000 a language."""
    groups = F.array_distinct(F.array("language", F.lit("und")))
    pairs = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in (*STATS, *SHARES)))
    different = profiled.where("language IS NOT NULL").groupBy("text_hash").agg(F.first("language").alias("language"), *(F.first(s).alias(s) for s in (*STATS, *SHARES)))
    counted = different.select(F.explode(groups).alias("language"), *STATS, *SHARES).select("language", F.explode(pairs).alias("x")).groupBy("language", F.col("x.stat").alias("stat"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))
    placed = running(counted.withColumn("key", F.concat_ws("\x1f", "language", "stat")), "key", ["value"], "n")
    return placed.drop("key")


def scored(profiled: DataFrame) -> DataFrame:
    """profiled with `score`, `margin` and `kind`.

    score: the sum over STATS of -log10 of the two-sided tail probability. margin: the largest score of a kind over its bar (see
    above), kind: that kind. All are taken among the texts of the row's language and among all, and the larger one counts, as a
    language with few texts has no tails. A row with a margin of 0 or more is a case.
    """
    known: dict[str, tuple] = {}
    table = ecdf(profiled).toPandas()  # bounded by the quantised values
    for (language, stat), g in table.groupby(["language", "stat"]):
        g = g.sort_values("value")
        values = g["value"].to_numpy()
        lower = (g["before"] + g["n"]).to_numpy() / g["total"].to_numpy()
        upper = (g["total"] - g["before"]).to_numpy() / g["total"].to_numpy()
        if stat in SHARES:
            at = np.searchsorted(values, 0.5)  # a half of the body: the least value there is from it on
            known[f"{language}\x1f{stat}"] = (values, -np.log10(upper) + (np.log10(upper[at]) if at < len(values) else -9.0))
        else:
            known[f"{language}\x1f{stat}"] = (values, -np.log10(np.minimum(1, 2 * np.minimum(lower, upper))))
    shared = profiled.sparkSession.sparkContext.broadcast(known)
    names = profiled.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = np.array(batch.column("language").to_pylist(), object)
            missing = np.array([x is None for x in language], bool)
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            values = {c: number(c) for c in (*STATS, *SHARES)}
            score = np.zeros(batch.num_rows)
            margin = np.full((batch.num_rows, len(KINDS)), -9.0)
            for lang in {x for x in language if x is not None} | {"und"}:
                at = np.flatnonzero(~missing if lang == "und" else language == lang)
                if not len(at):
                    continue

                def level(stat: str, lang: str = lang, at: np.ndarray = at) -> np.ndarray:
                    points, logs = shared.value[f"{lang}\x1f{stat}"]
                    return logs[np.searchsorted(points, values[stat][at])]

                own = sum(level(s) for s in STATS)
                context = CONTEXT * np.maximum(0, own / len(STATS) - TYPICAL)
                score[at] = np.maximum(score[at], np.round(own, 6))
                for k, s in enumerate(SHARES):
                    fits = values[s][at] >= LEAST_SHARE
                    margin[at, k] = np.maximum(margin[at, k], np.where(fits, level(s) + context, -9.0))
            shares = np.stack([np.nan_to_num(values[s]) for s in SHARES], axis=1)
            best = shares.argmax(axis=1)
            top = np.round(margin[np.arange(len(best)), best], 6)
            kind = np.array(KINDS, object)[best]
            kind[(top < 0) | missing] = None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, mask=missing), pa.array(top, mask=missing), pa.array(kind, pa.string())], [*names, "score", "margin", "kind"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profiled.schema.fields)
    return profiled.mapInArrow(run, f"{fields}, score double, margin double, kind string")


def not_prose(found: DataFrame) -> DataFrame:
    """(id, kind) of scored rows whose main body is not prose."""
    return found.where("kind IS NOT NULL").select("id", "kind")
