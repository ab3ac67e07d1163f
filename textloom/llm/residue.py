"""Problem 7: unfilled template slots, dummy copy, error pages and script notices.

Each kind of slot has a grammar of its delimiters. A slot counts unless its surroundings show that it is quoted: inside a code
block or back ticks, in a row that is mostly code or symbols, or next to words that explain templates. Error pages and script
notices are texts that hold nothing else: short, with a message of failure and no other content.

Defined cases: a null title or text is read as empty and has no case of its own; a title alone can hold a placeholder; a row may
have several kinds; a title that only sounds like a failure is no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Slot grammars by delimiter. NAME is an identifier or a few words that name a value.
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+){0,5}"
_UPPER = r"[A-Z][A-Z0-9]*(?:[ _\-][A-Z0-9]+){0,4}"
_TAGS = "abbr|article|aside|audio|body|button|canvas|caption|code|div|em|embed|fieldset|figure|footer|form|head|header|html|iframe|img|input|label|legend|link|main|meta|nav|object|option|pre|script|section|select|small|span|strong|style|sub|sup|svg|table|tbody|textarea|tfoot|thead|title|tr|ul|var|video"
GRAMMARS = {
    "double_brace": rf"\{{\{{[{{%#]?\s*[#/&]?{_NAME}(?:\s*\|[^{{}}\n]{{0,40}})?\s*\}}\}}",
    "brace_percent": rf"\{{%-?\s*{_NAME}[^%{{}}\n]{{0,40}}%\}}",
    "dollar_brace": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash_brace": rf"#\{{\s*{_NAME}\s*\}}",
    "server_tag": rf"<%[=\-]?\s*{_NAME}\s*-?%>",
    "double_percent": rf"%%\s*{_NAME}\s*%%",
    "percent": r"(?<![%\w])%[A-Z][A-Z0-9_]{3,30}%(?![%\w])",
    "star_bar": rf"\*\|\s*{_NAME}\s*\|\*",
    "double_bang": rf"!!\s*{_NAME}\s*!!",
    "double_at": rf"@@\s*{_NAME}\s*@@",
    "double_hash": rf"(?<!#)##[ ]?{_UPPER}[ ]?##(?!#)",
    "double_tilde": rf"~~\s*[A-Za-z]+_[A-Za-z_]+\s*~~",
    "dunder": r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+){0,4}__(?!\w)",
    "double_bracket": rf"\[\[\s*{_NAME}\s*\]\]",
    "double_angle": rf"<<\s*{_NAME}\s*>>|«\s*[A-Za-z]+_[A-Za-z_]+\s*»|«[A-Z][a-z]+(?: [A-Z][a-z]+){{0,3}}»",
    "bracket_request": r"\[\s*(?:(?i:insert|enter|your|add|type|choose|select|name of|todo|tbd|placeholder|fill in)\b)[^\[\]\n]{0,60}\](?!\()",
    "bracket_upper": r"(?<!\!)\[(?=[A-Z _\-]{4,40}\])[A-Z]+(?:[ _\-][A-Z]+)*\](?![\(\[:])",
    "bracket_snake": r"\[[a-z]+(?:_[a-z0-9]+){1,4}\](?!\()",
    "brace_snake": r"(?<![\w$#{%])\{(?:[a-z]+(?:_[a-z0-9]+){1,4}|[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z]+(?:_[A-Z0-9]+)+)\}(?!\})",
    "angle_request": r"(?:<|&lt;)\s*(?:(?i:insert|enter|your|add)\s+[^<>\n]{1,50}|[^<>\n]{1,50}?\s+(?i:goes? here|here))\s*(?:>|&gt;)",
    "angle_snake": r"(?:<|&lt;)(?:[a-z]+(?:_[a-z0-9]+){1,4}|[A-Z]+(?:_[A-Z0-9]+)+)(?:>|&gt;)",
    "angle_escaped": rf"&lt;(?!(?:{_TAGS})\b)[a-z]{{3,}}(?: [a-z]+){{0,3}}&gt;",
    "at_member": r"(?<![\w.@/])@[A-Z][A-Za-z]*(?:\.[A-Z]\w*)+",
    "brace_number": r"(?<![\w$#{%\\)\]}])\{\d{1,2}\}(?!\})",
    "paren_request": r"\(\s*(?i:enter|insert|add your|fill in|type your|your)\s+[a-z][a-z ]{2,40}\)",
    "todo": r"(?<![\w])(?:TODO|FIXME|TBD|TBA|XXX)\s*:\s*(?i:add|insert|fill in|write|update|replace|complete|set|enter)\b[^\n.]{0,60}",
    "underscore_blank": r"(?i:name|date|phone|email|title|room)\s*:\s*_{4,}",
    "x_fill": r"(?<!\w)X{4,}(?!\w)|(?<!\w)(XX+) ?[a-z][a-z _]{2,30} ?\1(?!\w)",
}
SLOT = {k: re.compile(v) for k, v in GRAMMARS.items()}


_PART = re.compile(r"\\.|\[\^?\]?|\]|\(\?<?[!=]|[()]|.", re.S)


def _wide(pattern: str, bounds: bool = False) -> str:
    """A pattern for RE2 that matches wherever the given one does: without conditions on what is around, white space and word
    characters of any script. With bounds, which must stand beside ASCII letters of the pattern, word ends stay: RE2 sees more of them."""
    out, in_class, depth, skip = [], False, 0, 0  # skip: depth of the condition that is left out
    for part in _PART.findall(pattern):
        if in_class:
            part = {r"\s": r"\s\pZ\pC", r"\w": r"\w\pL\pN"}.get(part, part)
            part, in_class = (r"\[", True) if part[:1] == "[" else (part, part != "]")
        elif part[:1] == "[":
            in_class = True
        elif part[:1] == "(":
            depth += 1
            skip = skip or (depth if len(part) > 1 else 0)
        elif part == ")":
            depth -= 1
            if skip > depth:
                skip = 0
                continue
        else:
            part = {r"\b": r"\b" if bounds else "", r"\s": r"[\s\pZ\pC]", r"\w": r"[\w\pL\pN]", r"\S": "."}.get(part, part)
        if not skip:
            out.append(part)
    return "".join(out)


# For RE2 over whole batches: the grammars without their conditions. What it passes is read again by the grammars.
PREFILTER = "|".join(f"(?:{_wide(g)})" for k, g in GRAMMARS.items() if k != "x_fill") + "|XX"  # x_fill refers back, which RE2 can't
# Words by which a text explains templates instead of holding one unfilled.
TUTORIAL = re.compile(r"(?i)\b(?:placeholders?|template (?:language|syntax|tag|engine|file|variable)s?|templat(?:e|ing) tutorial|programming tutorial|merge (?:fields?|tags?)|mail merge|variables?|syntax|notation|curly|braces|delimiters?|escaped?|snippet|writes? (?:it|them) as|(?:is|are) written|for example, type|expands? to|substitut\w+|interpolat\w+|regular expressions?|source code|programming|set notation)\b")
_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|<(code|pre)\b.*?</\1>", re.S | re.I)
_INDENTED = re.compile(r"(?m)^(?: {4}|\t).*[;{}=()].*$")

# Stems of the customary dummy copy (words that begin so count).
FILLER_STEMS = (
    "lorem ipsum dolor amet amit consec adipis elit sed eiusm temp incid labor dolore magna magni aliq enim minim venia quis nostr exerc exer ullam nisi commo conseq duis aute irur repre volup velit esse cill fugi null paria excep sint occa cupid proid culp offic deser moll anim tell "
    "viver pulvi ornar egest portic portt vexa vestib curab pellen maece sollic phare tinci fauc bland semper element matt sagit ligul rhonc vulput euism susci tortor auct intege prae vivam phasell donec aenea mauris"
).split()
_STEM = re.compile(r"(?:%s)[a-z]*\Z" % "|".join(sorted(FILLER_STEMS, key=len, reverse=True)))
_WORD = re.compile(r"[^\W\d_]+")
FILLER_PHRASE = re.compile(
    r"(?i)\b(?:this is (?:some )?(?:sample|dummy|placeholder|filler|example|test) (?:text|copy|content|paragraph)|(?:sample|dummy|placeholder|filler) (?:text|copy|content) (?:goes )?here|dummy (?:text|copy|content|heading|paragraph|title|sentence)|(?:sample|filler|placeholder) copy shows"
    r"|(?:your|the) (?:text|copy|content) goes here|replace (?:it|this|these|them)(?: text| paragraph| copy| words)? (?:with|by) your own|replace this (?:text|paragraph|copy)|blah(?:[ ,]+blah){2,}"
    r"|texto de (?:ejemplo|relleno|prueba|exemplo|teste)|aqu[ií] (?:va|vai) (?:el|la|o) (?:texto|contenido|conte[uú]do)|texte (?:d'exemple|de remplissage|factice)|faux[ -]texte|blindtext|beispieltext|platzhaltertext)\b"
)
# For RE2: the phrases, or two stems one after the other. Most words of dummy copy begin with stems, so that some two are neighbours.
_STEMS = "|".join(sorted(FILLER_STEMS, key=len, reverse=True))
FILLER_PREFILTER = _wide(FILLER_PHRASE.pattern) + rf"|(?:^|\PL)(?:{_STEMS})[a-z]*\PL+(?:{_STEMS})"

# Messages of failure and of missing scripts, in several languages.
ERROR = re.compile(
    r"(?i)\b(?:(?:page|file|document|resource|url|site|content|link)s?\b[^.\n]{0,60}\b(?:(?:was |were |is |could |can |has |does )?(?:not|n't|no longer)\b[^.\n]{0,12}\b(?:found|exists?|available|located|retrieved|reach(?:ed|able))|(?:has|have|was|were) (?:been )?(?:moved|removed|deleted|retired)|(?:is|are) (?:un(?:available|reachable)|down|offline)|(?:cannot|can't|could not) be (?:found|displayed|loaded|reached|opened))"
    r"|requested (?:url|page|address|resource|file)\b[^\n]{0,80}\bnot\b|(?:not found|not located|nothing lives at|nothing (?:was )?found|leads? nowhere|link you followed is broken|(?:is|are) unavailable in)"
    r"|access (?:is |was )?(?:denied|forbidden)|(?:do not|don't) have (?:permission|access)|not authori[sz]ed|forbidden|permission denied"
    r"|(?:internal )?server (?:error|met a problem|is busy|is overloaded|could not)|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|did not answer within|upstream \S+ (?:did|timed|failed)"
    r"|(?:http|error|status)(?: code)?[ :\-]*[45]\d\d\b|\b[45]\d\d (?:gone|not found|forbidden|error|bad|internal|service|unauthori[sz]ed)|(?:was|has been|been) retired on"
    r"|(?:down|closed|offline) for (?:\w+ )?(?:maintenance|repairs?|upgrades?)|(?:under|undergoing) (?:\w+ )?maintenance|come back (?:later|after|soon)|try again (?:later|soon)"
    r"|something \S* ?(?:went )?wrong|oops\b|went wrong on our side|an? (?:unexpected |unknown )?(?:error|problem|exception) (?:has )?(?:occurred|happened)|unexpected error"
    r"|session (?:has |is )?(?:expired|timed out)|sign in again|too many requests|rate limit|(?:database|connection) (?:connection )?(?:error|could not be|failed|refused|timed out|was reset)|connection (?:refused|timed out|reset)"
    r"|traceback\b|(?:\w+)?exception\b[^.\n]{0,20}\b(?:at|in) line|stack trace|fatal error|syntax error|segmentation fault"
    r"|p[aá]gina no (?:encontrada|existe|disponible)|no se (?:ha )?(?:encontr\w+|pudo)|acceso denegado|error del servidor|(?:enlace|p[aá]gina) [^.\n]{0,30}ya no existe"
    r"|(?:seite|dokument|datei) [^.\n]{0,40}(?:nicht gefunden|nicht (?:mehr )?verf[uü]gbar|existiert nicht)|zugriff verweigert|nicht gefunden|serverfehler"
    r"|page (?:introuvable|non trouv[eé]e|inexistante)|introuvable|acc[eè]s (?:refus[eé]|interdit)|erreur (?:interne|du serveur|\d{3})|n'existe (?:pas|plus)"
    r"|p[aá]gina n[aã]o (?:encontrada|existe|dispon[ií]vel)|acesso negado|n[aã]o (?:foi )?encontrad[ao]|erro (?:interno|do servidor|\d{3}))"
)
SCRIPT = re.compile(
    r"(?i)(?:\b(?:java ?script|js|scripts?|scripting|active content|cookies)\b[^.\n]{0,80}\b(?:enabled?|disabled|required?s?|requires|needed|necessary|turn(?:ed)? (?:it |them )?(?:on|off)|switch(?:ed)? on|allow(?:ed)?|activate|blocked|off|support(?:ed)?|must)\b"
    r"|\b(?:enable|enabling|allow|activate|turn on|switch on|requires?|needs?|without|support|supports|blocked)\b[^.\n]{0,60}\b(?:java ?script|js|scripts?|scripting|active content)\b|\bturn them on in your browser\b"
    r"|\bnoscript\b|\bchecking (?:your|the) (?:browser|connection)|verify(?:ing)? (?:that )?you are (?:a )?human|\bjust a moment\b|\bplease wait while\b|\bddos protection\b|^\s*loading\b"
    r"|(?:schalten|aktivieren) sie[^.\n]{0,40}(?:java ?script|skripte?)|java ?script (?:ist |muss )?[^.\n]{0,30}(?:aktivier|ein(?:ge)?schalt)|active[rz]?[^.\n]{0,20}java ?script|(?:habilite|active|permita|ative|habilitar)[^.\n]{0,30}(?:java ?script|scripts?)|(?:activer|activez|autorisez)[^.\n]{0,30}(?:java ?script|scripts?)|java ?script [^.\n]{0,30}(?:d[eé]sactiv|requis|necess[aá]ri|deshabilit|desativ))"
)
# Advice, codes and courtesies that come with a message.
ADVICE = re.compile(
    r"(?i)\b(?:check (?:the|your)|try (?:again|another|later|a)|go back|return to|back to (?:the )?(?:home|previous|start)|home ?page|start page|reload|refresh|search (?:box|for|the)|use the (?:menu|search)|contact|help ?desk|support|administrator|webmaster|sorry|apologi[sz]e|inconvenience|please|reference(?: id| number)?|request id|incident|ray id|trace|error id|report (?:the|this)|bookmark|address|spelling|sign in|log ?in|browser|seconds?|minutes?|moment|wait|redirected|thank you|we are working|working on it|technical|soon|later"
    r"|vuelva|int[eé]ntelo|por favor|disculpe|compruebe|bitte|entschuldigen|versuchen|pr[uü]fen|veuillez|d[eé]sol[eé]|r[eé]essayez|tente|verifique|desculpe)\b"
)
MESSAGES = tuple(_wide(p.pattern, bounds=True) for p in (ERROR, SCRIPT))  # for RE2

_HEADING = re.compile(r"^\s*#{1,6}\s+\S")
_CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:var|let|const|function|def|class|import|return|if|for|while)\b.*[({;:]|^\s*[.#][\w\-]+\s*\{")


def _is_code(text: str) -> bool:
    """Mostly code lines, or mostly symbols."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    if sum(1 for x in lines if _CODE_LINE.search(x)) >= 0.5 * len(lines) and len(lines) > 1:
        return True
    dense = [c for c in text if not c.isspace()]
    return len(dense) > 40 and sum(1 for c in dense if c.isalnum()) < 0.55 * len(dense)


def placeholders(text: str) -> list[str]:
    """Grammars with an unfilled slot in the text, quoted and explained ones discounted."""
    if not text or _is_code(text):
        return []
    quoted = [m.span() for m in _FENCE.finditer(text)] if "`" in text or "<" in text else []
    quoted += [m.span() for m in _INDENTED.finditer(text)] if "    " in text or "\t" in text else []
    found = []
    for name, pattern in SLOT.items():
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, b in quoted):
                continue
            around = text[max(0, m.start() - 80) : m.start()] + " " + text[m.end() : m.end() + 80]
            a, b = max(0, m.start() - 160), m.end() + 160
            near = text[a:b]
            dense = sum(1 for c in near if c.isalnum() or c.isspace())
            if TUTORIAL.search(around) or (len(near) > 60 and dense < 0.6 * len(near)):
                continue
            found.append(name)
            break
    return found


FILLER_LEAST_WORDS = 4  # of a line that is judged by its stems; of 3 words or fewer names may look like stems


def filler_share(paragraph: str) -> float:
    words = _WORD.findall(paragraph.lower())
    return sum(1 for w in words if _STEM.match(w)) / len(words) if len(words) >= FILLER_LEAST_WORDS else 0.0


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def is_filler(text: str, share: float = 0.7) -> bool:
    """Whether a line or a paragraph of the text is dummy copy: most of its words, or a third of its sentences by a customary phrase."""
    for paragraph in text.split("\n"):
        if FILLER_PHRASE.search(paragraph) and not TUTORIAL.search(FILLER_PHRASE.sub("", paragraph)):
            sentences = [s for s in _SENTENCE.split(paragraph) if s.strip()]
            if 3 * sum(1 for s in sentences if FILLER_PHRASE.search(s)) >= len(sentences):
                return True
        if filler_share(paragraph) >= share:
            return True
    return False


def message_kind(text: str) -> str | None:
    """"script_notice" or "error_page" where the text has nothing but such a message.

    A quarter of its sentences are messages, and those that are neither messages nor the advice that goes with them are no more than
    half. The length of the text does not matter; a text with a heading and more than two other lines is content.
    """
    content = [x.strip() for x in text.split("\n") if x.strip()]
    sentences = [s for s in _SENTENCE.split("\n".join(content)) if s.strip()]
    script = sum(1 for s in sentences if SCRIPT.search(s))
    error = sum(1 for s in sentences if ERROR.search(s))
    if not script and not error:
        return None
    advice = sum(1 for s in sentences if ADVICE.search(s) or SCRIPT.search(s) or ERROR.search(s))
    if 4 * max(script, error) < len(sentences) or 2 * advice < len(sentences):
        return None
    if any(_HEADING.match(x) for x in content) and len(content) > 3 and advice < len(sentences) - 1:
        return None
    return "script_notice" if script >= error else "error_page"


def kinds(title: str | None, text: str | None, slot: bool = True, copy: bool = True, message: bool = True) -> list[str]:
    """Kinds of residue of one row, in a fixed order. slot, copy and message: whether the row can have such a part at all."""
    title, text = title or "", text or ""
    slots = placeholders(text) if slot else []
    filler = copy and bool(text) and is_filler(text)
    only = message_kind(text) if message and text and not slots and not filler else None
    return [k for k, found in (("placeholder", slots or slot and placeholders(title)), ("filler", filler), (only, only)) if found]


def cases(titles: pa.Array, texts: pa.Array) -> list[list[str]]:
    """Kinds of residue of each row; the rules read the rows that the patterns for whole batches pass."""
    title, text = pc.fill_null(titles, ""), pc.fill_null(texts, "")
    slot = pc.or_(pc.match_substring_regex(text, PREFILTER), pc.match_substring_regex(title, PREFILTER))
    copy = pc.match_substring_regex(text, FILLER_PREFILTER)
    message = pc.or_(*(pc.match_substring_regex(text, m) for m in MESSAGES))
    out: list[list[str]] = [[]] * len(title)
    for i in np.flatnonzero(pc.or_(pc.or_(slot, copy), message).to_numpy(zero_copy_only=False)).tolist():
        out[i] = kinds(title[i].as_py(), text[i].as_py(), slot[i].as_py(), copy[i].as_py(), message[i].as_py())
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = cases(batch.column(1), batch.column(2))
        ids = batch.column(0).take(pa.array([i for i, ks in enumerate(found) for _ in ks], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([k for ks in found for k in ks], pa.string())], ["id", "kind"])


def residue(rows: DataFrame, id_col: str = "rec_id", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(id, kind): each kind of residue of each row; no shuffle."""
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(title_col).cast("string").alias("title"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_batches, "id long, kind string")


def without_residue(rows: DataFrame, found: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """rows whose id has no residue; a row with a null id is kept."""
    bad = found.select(F.col("id").alias("_bad_id")).distinct()
    return rows.join(bad, F.col(id_col) == F.col("_bad_id"), "left_anti")
