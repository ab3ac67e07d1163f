"""Problem 5: defective prompt and response pairs.

A response is aligned with its prompt by shingle containment and longest common subsequence to find copies, with refusal
templates to find refusals, by function words with the prompt's language, and by its last words with the sentence ends of the
whole table to find texts that break off.

Defined cases: a null or blank response is empty; a null prompt allows neither a copy nor a foreign language; one response has at
most one defect, in the order of DEFECTS; equal rows under different ids are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.languages import language, scores

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")
WORD = re.compile(r"[^\W_]+")

# Stand-ins for an answer, compared as their words.
STAND_INS = {
    "n a", "na", "none", "null", "nil", "nan", "tbd", "tba", "todo", "to do", "no answer", "no response", "answer", "response", "unknown", "pending", "empty", "blank", "missing", "undefined", "not available", "not applicable",
    "no answer given", "no answer provided", "no answer available", "answer pending", "answer goes here", "answer here", "your answer here", "insert answer", "insert answer here", "to be added", "to be completed", "to be determined", "to be filled in",
    "coming soon", "see above", "placeholder", "none given", "not provided", "no data", "no content", "sin respuesta", "respuesta", "ninguna", "ninguno", "nada", "no disponible", "pendiente", "lorem ipsum", "xxx", "x", "a", "q", "thought", "thoughts", "reasoning",
}
LABEL = re.compile(r"(?i)^\s*(?:(?:the )?(?:answer|response|reply|question|respuesta|pregunta|thoughts?|reasoning|q|a)\s*[:.\-]\s*)+")
LABEL_WORDS = {"q", "a", "answer", "question", "response", "pregunta", "respuesta", "thought", "the", "you", "asked", "is", "reply"}

# What templates are made of. A word that ends in * stands for all that begin so.
CLASSES = {
    "I": "i we",
    "ME": "me us",
    "MY": "my our the",
    "DO": "answer* help* assist* respond* reply* comply* provid* share* give* discuss* disclos* comment* say* tell* complet* fulfil* process* support* handl* address* offer* advis* do continu* engag* speak*",
    "SORRY": "sorry afraid",
    "HAVE": "have find know possess locate see",
    "INFO": "information answer* detail* access data knowledge that enough context",
    "THIS": "this that your the such any",
    "QUESTION": "question* request* query quer* inquir* topic",
    "DECLINE": "decline refuse pass",
    "AI": "ai artificial language assistant automated virtual",
    "RULES": "policy policies guidelines rules programming",
    "SCOPE": "scope ability abilities capabilit* remit knowledge",
    "HACER": "responder* contestar* ayudar* asistir* proporcionar* dar* facilitar* compartir* atender*",
    "DISPONER": "dispongo disponemos tengo tenemos",
    "ESA": "esa la esta suficiente ninguna acceso",
    "NEGARME": "negarme rechazar declinar abstenerme",
    "HECHO": "answered fulfilled processed completed",
    "GIVEN": "given provided offered supplied shared",
}
# Ways to say no, each read as the one word NOT (or NO PUEDO) before templates are aligned.
SAY_NOT = (
    "cannot|can not|can t|cant|could not|couldn t|couldnt|am not able to|m not able to|are not able to|re not able to|am unable to|m unable to|are unable to|re unable to|will not be able to|won t be able to|will not|won t|wont"
    "|am not allowed to|m not allowed to|am not permitted to|m not permitted to|am not in a position to|m not in a position to|would rather not|d rather not|would prefer not to|would prefer not|d prefer not to|d prefer not|decline to|refuse to"
    "|must respectfully decline to|must decline to|must refuse to|have to decline to|have to refuse to|do not want to|don t want to|do not wish to|don t wish to"
).split("|")
SAY_NO_PUEDO = "no puedo|no podemos|no me es posible|no es posible para mi|no es posible para mí|no estoy en condiciones de|no estoy autorizado a|no estoy autorizada a|no soy capaz de".split("|")
# Refusal templates. Words that a class above names stand for it; up to GAP words may lie between two of them.
TEMPLATES = [
    "I NOT DO", "I must DECLINE", "I have to DECLINE", "I need to DECLINE", "I will DECLINE", "I would like to DECLINE", "I am not comfortable", "I m not comfortable", "I do not feel comfortable", "I don t feel comfortable", "I do not HAVE INFO", "I don t HAVE INFO", "I did not HAVE INFO",
    "I didn t HAVE INFO", "I NOT HAVE INFO", "it is not possible for ME", "it isn t possible for ME", "it s not possible for ME", "it is impossible for ME", "not something that I can", "not something I can", "not a QUESTION I can", "not a QUESTION that I can", "not a QUESTION I am", "not enough INFO for ME", "not enough INFO to DO",
    "insufficient INFO for ME", "insufficient INFO to DO", "no INFO for ME", "no INFO to DO", "as an AI", "as a AI model", "against my RULES", "against our RULES", "outside MY SCOPE", "beyond MY SCOPE", "I am SORRY NOT DO", "I m SORRY NOT DO", "unable to DO THIS QUESTION", "unable to DO THIS", "THIS QUESTION NOT be HECHO",
    "THIS QUESTION may not be HECHO", "no INFO can be GIVEN", "no INFO could be GIVEN", "no INFO will be GIVEN", "NOPUEDO HACER", "no se puede HACER", "no DISPONER de ESA", "no DISPONER ESA", "debo NEGARME", "me niego a", "prefiero no HACER",
]
GAP = 3


def _compiled() -> list[list[tuple[set[str], tuple[str, ...]]]]:
    out = []
    for template in TEMPLATES:
        parts = []
        for part in template.split():
            options = CLASSES.get(part, part).split()
            parts.append(({w for w in options if not w.endswith("*")}, tuple(w[:-1] for w in options if w.endswith("*"))))
        out.append(parts)
    return out


_COMPILED = _compiled()
# A word of each template that few texts have: templates whose rare word is missing are not aligned.
_RARE = [max((w for part in t.split() for w in ([part] if part not in CLASSES else [])), key=lambda w: (w in ("NOT", "NOPUEDO"), len(w)), default=None) for t in TEMPLATES]
_SAYINGS = re.compile(r"(?<!\S)(?:(" + "|".join(sorted(SAY_NOT, key=len, reverse=True)) + r")|(" + "|".join(sorted(SAY_NO_PUEDO, key=len, reverse=True)) + r"))(?!\S)")


def align(template: list[tuple[set[str], tuple[str, ...]]], text: list[str]) -> int | None:
    """Fewest words of the text between the template's words, aligned in order with at most GAP in one place; None if it can't be."""
    reach: list[tuple[int, int]] = []  # (cost, place) of alignments up to the part before
    for k, (words_, stems) in enumerate(template):
        step: dict[int, int] = {}
        for place, w in enumerate(text):
            if w not in words_ and not (stems and w.startswith(stems)):
                continue
            if k == 0:
                step[place] = 0
                continue
            costs = [cost + place - at - 1 for at, cost in reach if 0 <= place - at - 1 <= GAP]
            if costs:
                step[place] = min(costs)
        if not step:
            return None
        reach = list(step.items())
    return min(cost for _, cost in reach)


def is_refusal(answer: str) -> bool:
    """Whether a sentence of the answer aligns with a refusal template."""
    for sentence in re.split(r"[.!?\n]+(?=\s|$)", answer):
        text = _SAYINGS.sub(lambda m: "NOT" if m.group(1) else "NOPUEDO", " ".join(words(sentence))).split()
        have = set(text)
        for template, rare in zip(_COMPILED, _RARE):
            if (rare is None or rare in have) and align(template, text) is not None:
                return True
    return False


# Words a finished text does not end with.
OPEN_WORDS = set(
    "the a an of to and or but nor with without for from by in on at as into onto about between under over than then that which who whose where when while because since although if unless until so is are was were be been being has have had do does did can could may might must shall should will would not no very more most this these those its their your our my his her you we they he she it i "
    "el la los las un una unos unas de del al y o u e que en con por para sin sobre entre como cuando donde si porque se su sus es son está están ha han lo le les".split()
)
STOPS = ".!?…。"
CLOSERS = "\"'”’»)]}*_`"
LIST_LINE = re.compile(r"^\s*(?:[-*•‣–]|\d+[.)]|\(?[a-z][.)])(?:\s|$)")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_containment(inner: list[str], outer: list[str], k: int = 3) -> float:
    """Share of the inner list's k-word shingles that the outer list has; of words where it is shorter than k."""
    k = max(1, min(k, len(inner), len(outer)))
    have = {tuple(outer[i : i + k]) for i in range(len(outer) - k + 1)}
    mine = [tuple(inner[i : i + k]) for i in range(len(inner) - k + 1)]
    return sum(1 for s in mine if s in have) / len(mine) if mine else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of integers."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit) | (row - hit)
    return bin(~row & full).count("1")


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer gives only the question back, once or more, whatever its case, marks and labels.

    Each run of the answer's words that the question explains is taken out; a copy covers most of the question and leaves
    nothing but labels.
    """
    q = words(question)
    a = [w for w in words(LABEL.sub("", answer))]
    if len(q) < 2 or not a:
        return False
    once = a[: len(q) + 4]
    if common_subsequence(once, q) < 0.75 * len(q):
        return False
    left = [w for w in a if w not in LABEL_WORDS]
    bag = set(q)
    foreign = sum(1 for w in left if w not in bag)
    repeats = max(1, round(len(left) / max(1, len([w for w in q if w not in LABEL_WORDS]))))
    covered = common_subsequence(left, [w for w in q if w not in LABEL_WORDS] * repeats)
    return foreign <= 0.05 * len(left) and covered >= 0.85 * len(left) and shingle_containment([w for w in q], a) >= 0.7


def last_words(text: str) -> str:
    """The last three words, with digits as 0 and names as N: the key of a sentence end."""
    tail = re.findall(r"[^\W_]+", text[-120:])[-3:]
    key = " ".join("0" if w.isdigit() else "N" if w[:1].isupper() else w for w in tail)
    return "" if len(tail) < 3 and set(key.split()) <= {"0", "N"} else key  # a number or name alone tells nothing


def ending(text: str) -> str:
    """"whole", "broken", or "open" where only the words tell whether the text is finished."""
    t = text.rstrip()
    bare = t.rstrip(CLOSERS).rstrip() if t[-1:] in CLOSERS else t
    if not bare:
        return "broken"
    if bare[-1] in STOPS and not bare.endswith((" .", ",.")):
        return "whole"
    if bare[-1] in ",;:([{–—-/&“«" or bare.endswith(("e.g", "i.e")):
        return "broken"
    lines = [x for x in t.split("\n") if x.strip()]
    if LIST_LINE.match(lines[-1]) and not words(LIST_LINE.sub("", lines[-1])):
        return "broken"
    if t[-1] in ")]”»" and bare != t:
        return "whole"
    tail = words(bare)
    if not tail:
        return "broken"
    if tail[-1] in OPEN_WORDS:
        return "broken"
    if t.count("(") > t.count(")") or t.count("“") > t.count("”"):
        return "broken"
    if len(lines) == 1 and not any(w in OPEN_WORDS for w in tail) and len(tail) <= 8:
        return "whole"
    return "open"


def judge(question: str | None, answer: str | None) -> str | None:
    """The defect of a response, "open <last words>" where the corpus has to tell whether it breaks off, or None."""
    if answer is None:
        return "empty"
    plain = " ".join(words(answer))
    if not plain or plain in STAND_INS or (LABEL.match(answer) and " ".join(words(LABEL.sub("", answer))) in STAND_INS | {""}):
        return "empty"
    if question and is_copy(question, answer):
        return "copied_question"
    if is_refusal(answer):
        return "refusal"
    if question:
        asked, given = language(question), language(answer, least=2.0)
        if given == "und":  # a short text: one function word of another language is enough if there is none of the question's
            found, _ = scores(answer)
            given = language(answer) if not found.get(asked) else given
        if "und" not in (asked, given) and asked != given:
            return "other_language"
    end = ending(answer)
    if end == "broken":
        return "truncated"
    return f"open {last_words(answer)}" if end == "open" else None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fields, found = [], [], []
        for i, q, a, t in zip(*(c.to_pylist() for c in batch.columns)):
            for field, value in (("answer", a), ("thought_process", t)):
                if verdict := judge(q, value):
                    ids.append(i)
                    fields.append(field)
                    found.append(verdict)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(found, pa.string())], ["id", "field", "verdict"])


_SENTENCE_END = re.compile(r"[^\W_][\"”’)]*[.!?](?=\s|$)")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: dict[str, int] = {}
        for column in batch.columns:
            for text in column.to_pylist():
                for m in _SENTENCE_END.finditer(text or ""):
                    k = last_words(text[max(0, m.end() - 120) : m.end()])
                    keys[k] = keys.get(k, 0) + 1
                for line in (text or "").split("\n"):  # whole items of lists end without a stop, unless they are last
                    if LIST_LINE.match(line) and not text.endswith(line):
                        keys[k] = keys.get(k := last_words(line), 0) + 1
        keys.pop("", None)
        yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array(list(keys.values()), pa.int64())], ["key", "n"])


def defects(pairs: DataFrame, id_col: str = "raft_id", question_col: str = "question", answer_col: str = "answer", thought_col: str = "thought_process", other_cols: tuple[str, ...] = ("oracle", "context")) -> DataFrame:
    """(id, field, defect) of each defective response.

    Responses that end in a word are compared with the sentence ends of all texts of the table: an equi-join of the few open
    responses with the pre-aggregated keys.
    """
    text = lambda c: F.col(c).cast("string")
    judged = pairs.select(F.col(id_col).cast("long").alias("id"), text(question_col).alias("q"), text(answer_col).alias("a"), text(thought_col).alias("t")).mapInArrow(_judged, "id long, field string, verdict string")
    known = [c for c in (answer_col, thought_col, *other_cols) if c in pairs.columns]
    ends = pairs.select(*(text(c).alias(f"c{i}") for i, c in enumerate(known))).mapInArrow(_ends, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    sure = judged.where(~F.startswith("verdict", F.lit("open "))).select("id", "field", F.col("verdict").alias("defect"))
    open_ = judged.where(F.startswith("verdict", F.lit("open "))).select("id", "field", F.expr("substring(verdict, 6)").alias("key"))
    return sure.unionByName(open_.join(ends, "key", "left_anti").select("id", "field", F.lit("truncated").alias("defect")))
