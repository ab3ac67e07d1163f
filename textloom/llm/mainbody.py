"""Problem 1: the main body of pages whose text still carries site furniture.

A text is read as a small document tree: the row, blocks of alike neighbouring lines, and lines. Gradient-boosted trees score
lines and blocks from features of these nodes: density of words, links and function words in the subtree, attribute tokens
(groups of words that furniture uses), depth (indent, heading and list level) and statistics of siblings. Hierarchical decoding
picks one labelling of the tree, so that a block and its lines never contradict each other.

Training labels are weak, from a bounded sample (MAX_TRAINING_ROWS rows of MAX_TRAINING_HOSTS sites and MAX_TRAINING_PAGES crawled
pages): the mark-up of crawled pages (nav, aside, header and footer against main), and repetition of lines and of their patterns within
a site. No list of phrases takes part; GROUPS has single words as attribute tokens.

Defined cases: null and empty texts have no lines; rows whose source_type is "pdf" are not web rows and have no cases; blank lines
are never furniture; a null source_type is a web row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import boosting, tokens
from textloom.llm import lines as lines_of
from textloom.llm.languages import OF_WORD

MAX_TRAINING_ROWS = 2500
MAX_TRAINING_HOSTS = 25
LEAST_SITE = 30  # rows of a site from which on it is used for training, where there are such sites
MAX_TRAINING_PAGES = 300
MAX_TRAINING_LINES = 12000

# Attribute tokens, words that kinds of furniture use.
GROUPS = {
    "nav": "home about contact directory news events calendar apply visit give alumni athletics parents students staff faculty library campus life dining housing parking maps safety policies forms jobs careers tuition portal email bookstore research programs majors academics admissions a-z index login explore departments".split(),
    "consent": "cookie cookies privacy consent vendors identifiers device browser storage essential preferences choices analytics gdpr settings sold optional agree tracking".split(),
    "button": "accept reject close decline manage save ok got agree learn more allow dismiss".split(),
    "share": "share shared sharing like liked saved follow friend post tag pass copy tweet pin send print enjoyed readers people save later tell".split(),
    "signup": "newsletter subscribe subscription sign alerts inbox updates mailing enter register receive".split(),
    "byline": "by written posted updated last story photo published author reporter reviewed maintained min read since edited contributor".split(),
    "legal": "reserves right liability liable accredited commission responsible notice guidance accepts errors external linked offerings equal discriminate nondiscrimination report annual independent contract copyright university reserves publishes safety commission campus centre school including held".split(),
    "footer": "copyright rights reserved terms accessibility statement disclosures trustees road street avenue phone tel call fax help privacy notice feedback web concern records alerts emergency employer site services".split(),
    "skip": "skip jump toggle menu search top start back return main content region index navigation".split(),
    "sidebar": "related also section quick links upcoming previous next box ext see popular topics trending archive tags categories pages".split(),
}
NAMES = list(GROUPS)
_BIT: dict[str, int] = {}
for _k, _words in enumerate(GROUPS.values()):
    for _w in _words:
        _BIT[_w] = _BIT.get(_w, 0) | 1 << _k
WORD = re.compile(r"[^\W_]+")
LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\s]*)\)")
BULLET = re.compile(r"^(?:([-*•‣·▪])|(\d{1,3}[.)]|\([a-z0-9]{1,3}\)|[a-z][.)])|([☐☑✓✔]))\s")
HEADING = re.compile(r"^(#{1,6})\s")
PHONE = re.compile(r"\(?\d{3}\)?[ .\-–]\d{3}[\-. ]\d{4}|\btel\b|\bext\.? ?\d", re.I)
DATE = re.compile(r"\b\d{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{4}\b|\b\d{4}-\d\d-\d\d\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b", re.I)
YEAR = re.compile(r"\b(?:19|20)\d\d\b")
EMAIL = re.compile(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")
STOP = re.compile(r"[.!?…][\"'”’)\]]*$")
SPACES = re.compile(r"\s+")
MARKS = "▾▸▼×↑«»©®→←☰⌄›"

BASE_NAMES = ["words", "chars", "indent", "bullet", "heading", "stop", "link_share", "links", "function_share", "function_words", "title_share", "caps", "digit_share", "bars", "dots", "arrows", "slashes", "marks", "phone", "email", "date", "year", "paren_tail", "commas", "wide_gaps", "tabs", "colons", "bar_first", "tag", "own_links", "bold", "rule", *NAMES]
N_BASE = len(BASE_NAMES)
COL = {n: i for i, n in enumerate(BASE_NAMES)}


class Vocabulary:
    """Numbers of given words, found by their hashes; 0 for all others."""

    def __init__(self, numbers: dict[str, int]):
        names = list(numbers)
        h = tokens.Words(pa.array(names, pa.string())).hash
        if len(h) != len(names):
            raise ValueError("each entry must be one word")
        order = np.argsort(h)
        self.hash, self.number = h[order], np.array([numbers[n] for n in names], np.int64)[order]
        self.near = np.zeros(1 << 16, bool)  # most words are dismissed by their first bits
        self.near[(h >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        out[at] = np.where(self.hash[place] == h[at], self.number[place], 0)
        return out


_SEVERAL = [w for w in {*OF_WORD, *_BIT} if len(WORD.findall(w)) > 1]  # "a-z" is two words and never one of a line
_FUNCTION = 1 << len(NAMES)
_LONG_FUNCTION = _FUNCTION << 1  # of more than one letter
LINE_WORDS = Vocabulary({w: _BIT.get(w, 0) | (_FUNCTION if w in OF_WORD else 0) | (_LONG_FUNCTION if w in OF_WORD and len(w) > 1 else 0) for w in {*OF_WORD, *_BIT} if w not in _SEVERAL})


def _per_line(words: tokens.Words, values: np.ndarray) -> np.ndarray:
    """Sums of a value per word over the words of each line."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return (sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.float64)


def _on(lines: pa.Array, some: np.ndarray, count) -> np.ndarray:
    """count of the lines that `some` picks, 0 for the others."""
    out = np.zeros(len(lines))
    at = np.flatnonzero(some)
    if len(at):
        out[at] = np.asarray(count(lines.take(pa.array(at))).to_numpy(zero_copy_only=False), np.float64)
    return out


def byte_counts(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many bytes of each row a mask of byte values picks."""
    sums = np.concatenate(([0], np.cumsum(wanted[data])))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
_SPACE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"


def line_features(lines: pa.Array, hosts: list[str]) -> tuple[np.ndarray, tokens.Words, np.ndarray, pa.Array]:
    """(features by BASE_NAMES, words, word numbers by LINE_WORDS, stripped lines) of non-blank lines, whole batches at a time."""
    number = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
    left = pc.replace_substring_regex(lines, rf"^{_SPACE}+", "") if len(lines) else lines
    s = pc.replace_substring_regex(left, rf"{_SPACE}+$", "")
    words = tokens.Words(s)
    n = words.count.astype(np.float64)
    known = LINE_WORDS(words.hash)
    data, offsets = tokens.raw(s)
    chars = number(pc.utf8_length(s))
    upper = np.zeros(len(words.hash), bool)  # words that begin with a capital: their bytes differ from the lower-cased ones
    cased, cased_offsets = tokens.raw(pc.binary_join_element_wise(pc.replace_substring_regex(s, r"[^\p{L}\p{N}\x00-\x7F]", " "), "", "\n"))
    fits = np.flatnonzero((np.diff(cased_offsets) == np.diff(words.offsets))[words.doc])  # lower-casing has changed no length
    at = words.start[fits]
    there = cased_offsets[words.doc[fits]] + at - words.offsets[words.doc[fits]]
    upper[fits] = cased[there] != words.data[at]
    wide = fits[words.data[at] >= 0xC3]
    upper[wide] |= cased[cased_offsets[words.doc[wide]] + words.start[wide] - words.offsets[words.doc[wide]] + 1] != words.data[words.start[wide] + 1]
    digits = byte_counts(data, offsets, DIGITS)
    ascii_ = np.asarray(pc.string_is_ascii(s).to_numpy(zero_copy_only=False), bool)
    count = lambda what: number(pc.count_substring(s, what))
    starts = lambda what: number(pc.starts_with(s, what))
    match = lambda p: (lambda x: pc.match_substring_regex(x, p))
    first = data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(s), np.uint8)
    marked = ~(((first >= 65) & (first <= 90)) | ((first >= 97) & (first <= 122)))
    bullet = _on(s, marked, match(rf"^[\-*•‣·▪]{_SPACE}"))
    bullet += 2 * _on(s, (bullet == 0), match(rf"^(?:[0-9]{{1,3}}[.)]|\([a-z0-9]{{1,3}}\)|[a-z][.)]){_SPACE}"))
    bullet += 3 * _on(s, marked & (bullet == 0), match(rf"^[☐☑✓✔]{_SPACE}"))
    sharp = first == 35
    heading = np.zeros(len(s))
    for k in range(1, 7) if sharp.any() else ():
        heading += k * _on(s, sharp, match(rf"^#{{{k}}}{_SPACE}"))
    stop = number(pc.match_substring_regex(pc.utf8_slice_codeunits(s, -8, 1 << 30), "[.!?…][\"'”’)\\]]*$"))
    links, link_chars, own = np.zeros(len(s)), np.zeros(len(s)), np.zeros(len(s))
    for i in np.flatnonzero(count("](") > 0).tolist():
        found = LINK.findall(s[i].as_py())
        links[i], link_chars[i] = len(found), sum(len(a) + len(b) + 4 for a, b in found)
        own[i] = sum(1 for _, to in found if to[:1] in "#/." or (hosts[i] and hosts[i] in to))
    function = _per_line(words, (known & _FUNCTION) > 0)
    some = np.maximum(n, 1)
    groups = [_per_line(words, (known >> k) & 1) for k in range(len(NAMES))]
    pairs = lambda a, b: count(a) + _on(s, ~ascii_, lambda x: pc.count_substring(x, b))
    odd = lambda a, b: _on(s, ~ascii_, lambda x: pc.add(pc.count_substring(x, a), pc.count_substring(x, b)))
    columns = [
        n, chars, number(pc.utf8_length(lines)) - number(pc.utf8_length(left)), bullet, heading, stop, link_chars / np.maximum(chars, 1), links, function / some, function, _per_line(words, upper) / some,
        number(pc.utf8_is_upper(s)), digits / np.maximum(chars, 1), count(" | "), odd(" · ", " • "), pairs(" > ", " » "), count(" / "), _on(s, ~ascii_, lambda x: pc.count_substring_regex(x, f"[{MARKS}]")),
        _on(s, (digits > 0), lambda x: pc.match_substring_regex(x, PHONE.pattern, ignore_case=True)), _on(s, count("@") > 0, match(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+")),
        _on(s, digits > 0, lambda x: pc.match_substring_regex(x, DATE.pattern, ignore_case=True)), _on(s, digits > 0, match(YEAR.pattern)),
        number(pc.ends_with(s, ")")), count(","), count("  "), count("\t"), count(":"), starts("|"), starts("<"), own, starts("**") * number(pc.ends_with(s, "**")), (n == 0).astype(np.float64), *groups,
    ]
    return np.column_stack(columns), words, known, s


_HOST = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?(?:www\.)?([^/:?#\s]+)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match((url or "").strip().lower())
    return m.group(1) if m else ""


def split_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, line number, line) of the non-blank lines of texts."""
    array = pa.array(texts, pa.string())
    parts = pc.split_pattern(pc.fill_null(array, ""), "\n")
    offsets = parts.offsets.to_numpy()
    sizes = np.diff(offsets)
    lines = parts.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    number = np.arange(len(lines)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    some = np.asarray(pc.match_substring_regex(lines, r"[^\s\pZ\x0b\x1c-\x1f\x{85}]").to_numpy(zero_copy_only=False), bool) if len(lines) else np.zeros(0, bool)
    return row[some], number[some], lines.filter(pa.array(some))


@dataclass
class Lines:
    """Non-blank lines of a batch of rows: row, line number, base features, block, texts, words and their numbers."""

    row: np.ndarray
    number: np.ndarray
    base: np.ndarray
    block: np.ndarray
    text: pa.Array
    words: tokens.Words
    known: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], urls: list[str | None]) -> Lines:
        row, number, lines = split_lines(texts)
        hosts = [host_of(u) for u in urls]
        base, words, known, stripped = line_features(lines, [hosts[r] for r in row.tolist()])
        return cls(row, number, base, _blocks(row, base), stripped, words, known)


    def some(self, keep: np.ndarray) -> Lines:
        """The lines of whole rows that `keep` picks."""
        row, base = self.row[keep], self.base[keep]
        return Lines(row, self.number[keep], base, _blocks(row, base), self.text.filter(pa.array(keep)), self.words, self.known)


def _blocks(row: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Number of the block of each line: neighbours of one row and one shape."""
    if not len(row):
        return np.zeros(0, np.int64)
    prose = (base[:, COL["function_words"]] >= 3) & (base[:, COL["words"]] >= 7)
    shape = np.select(
        [base[:, COL["heading"]] > 0, base[:, COL["bullet"]] > 0, (base[:, COL["bar_first"]] > 0) | (base[:, COL["tag"]] > 0) | (base[:, COL["tabs"]] > 1), prose, base[:, COL["links"]] > 0, base[:, COL["words"]] <= 5],
        [1, 1 + base[:, COL["bullet"]], 5, 6, 7, 8], 9,
    )
    change = np.concatenate(([True], (np.diff(row) != 0) | (np.diff(shape) != 0) | (shape[1:] == 1)))
    return np.cumsum(change) - 1


def _shift(x: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """x of the line k further on in the same row, -1 where there is none."""
    out = np.full_like(x, -1.0)
    n = len(x)
    if abs(k) < n:
        a, b = (slice(0, n - k), slice(k, n)) if k > 0 else (slice(-k, n), slice(0, n + k))
        same = row[a] == row[b]
        out[a] = np.where(same[:, None] if x.ndim == 2 else same, x[b], -1.0)
    return out


def features(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Features of lines, and of blocks."""
    base, row, block = lines.base, lines.row, lines.block
    n = len(row)
    if not n:
        return np.zeros((0, 1)), np.zeros((0, 1))
    groups = base[:, COL[NAMES[0]] :]
    near = base[:, [COL[c] for c in ("words", "function_share", "stop", "bullet", "heading", "links", "title_share", "commas", "paren_tail")]]
    start = np.flatnonzero(np.concatenate(([True], np.diff(row) != 0)))
    size = np.diff(np.concatenate((start, [n])))
    at = np.arange(n) - np.repeat(start, size)
    left = np.repeat(size, size) - 1 - at
    is_head = base[:, COL["heading"]] > 0
    heads = np.cumsum(is_head)
    heads_before = heads - np.repeat(heads[start] - is_head[start], size)
    first = np.flatnonzero(np.concatenate(([True], np.diff(block) != 0)))
    count = np.diff(np.concatenate((first, [n])))
    mean = np.add.reduceat(base, first, axis=0) / count[:, None]
    most = np.maximum.reduceat(groups, first, axis=0)
    mean_words = mean[:, COL["words"]]
    spread = np.sqrt(np.maximum(np.add.reduceat(base[:, COL["words"]] ** 2, first) / count - mean_words**2, 0))
    before = _shift(base, row, -1)[first]
    after = _shift(base, row, 1)[first + count - 1]
    share = at[first] / np.repeat(size, size)[first]
    nav_share = np.add.reduceat((groups[:, 0] > 0).astype(float), first) / count
    blocks = np.column_stack((count, mean, most, spread, share, left[first + count - 1], at[first], heads_before[first] > 0, nav_share, before[:, [COL["words"], COL["heading"], COL["function_share"]]], before[:, COL[NAMES[0]] :], after[:, [COL["words"], COL["heading"], COL["function_share"]]]))
    per_line = blocks[block - block[0]]
    prev, nxt, prev2 = _shift(near, row, -1), _shift(near, row, 1), _shift(near, row, -2)
    own = np.column_stack((base, at, left, at / np.repeat(size, size), heads_before > 0, prev, nxt, prev2, _shift(groups, row, -1), _shift(groups, row, 1), _shift(groups, row, -2)[:, [NAMES.index("sidebar")]], np.arange(n) - first[block - block[0]]))
    return np.column_stack((own, per_line)), blocks


_DIGITS = re.compile("[0-9]+")
_CAPITAL = re.compile(r"\b[^\W\d_a-z]\w*")
_LOWER = re.compile("[a-z]{2}")
LEAST_REPEATS = 3  # rows of a site's sample that hold a line, from which on it is taken for furniture


def _support(keys: list[tuple | None], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold the key of each line, its occurrences per such row); no rows where the key is None."""
    rows: dict[tuple, set[int]] = {}
    times: dict[tuple, int] = {}
    for key, r in zip(keys, row.tolist()):
        if key is not None:
            rows.setdefault(key, set()).add(r)
            times[key] = times.get(key, 0) + 1
    n = np.array([len(rows[k]) if k is not None else 0 for k in keys], np.int64)
    return n, np.array([times[k] / len(rows[k]) if k is not None else 0.0 for k in keys])


def repetition_labels(lines: Lines, hosts: list[str]) -> np.ndarray:
    """Weak labels of the lines of sampled rows, by repetition within their site: 1 furniture, 0 body, -1 unknown.

    Furniture is a line in LEAST_REPEATS rows of the site, or one whose pattern (names and numbers left out) is, once a row, as
    bylines and date stamps are; and a block of short lines under a short furniture line, as in a sidebar. Body are headings, prose
    and blocks of lines that no other row of the site has, and rows of tables.
    """
    base, row, n = lines.base, lines.row, len(lines.row)
    col = lambda c: base[:, COL[c]]
    text = [SPACES.sub(" ", s) for s in lines.text.to_pylist()]
    where = [hosts[r] for r in row.tolist()]
    headed = (col("heading") > 0) | (col("bullet") > 0)  # these keep their numbers: numbered sections and items are the row's own
    same, _ = _support([(h, (s if own else _DIGITS.sub("0", s)).lower()) for h, s, own in zip(where, text, headed)], row)
    patterns = [(h, _DIGITS.sub("0", _CAPITAL.sub("N", s))) for h, s in zip(where, text)]
    shaped = (col("bullet") == 0) & (col("heading") == 0) & (col("bar_first") == 0) & (col("tag") == 0) & (col("tabs") <= 1) & (col("wide_gaps") <= 2)
    alike, times = _support([p if ok and _LOWER.search(p[1]) else None for p, ok in zip(patterns, shaped)], row)
    once = same == 1
    label = np.full(n, -1)
    label[once & (col("heading") > 0)] = 0
    label[once & (col("function_words") >= 4) & (col("words") >= 9) & (alike <= 1)] = 0
    label[(alike >= LEAST_REPEATS) & (times <= 1.2)] = 1
    label[same >= LEAST_REPEATS] = 1
    label[(col("bar_first") > 0) | (col("tag") > 0) | (col("tabs") > 1)] = 0
    first = np.flatnonzero(np.concatenate(([True], np.diff(lines.block) != 0))) if n else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n]):
        if b - a < 3:
            continue
        led = a > 0 and row[a - 1] == row[a] and label[a - 1] == 1 and col("words")[a - 1] <= 6 and col("links")[a - 1] == 0
        if led and (col("function_words")[a:b] < 3).all() and (col("commas")[a:b] == 0).all() and (col("bar_first")[a:b] + col("tag")[a:b] == 0).all():
            label[a:b] = 1
        elif once[a:b].mean() >= 0.7 and (label[a:b] != 1).all():
            label[a:b] = 0
    return label


class _Page(HTMLParser):
    """Lines of a crawled page, with 1 inside nav, aside, header and footer, and 0 inside main."""

    def __init__(self):
        super().__init__()
        self.lines: list[str] = []
        self.labels: list[int] = []
        self.now, self.zone, self.link, self.prefix = "", [], "", ""

    def _end(self):
        if self.now.strip():
            self.lines.append(self.prefix + self.now)
            self.labels.append(0 if "main" in self.zone else 1 if self.zone else -1)
        self.now, self.prefix = "", ""

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "aside", "header", "footer", "main", "title"):
            self._end()
            self.zone.append(tag)
        elif tag in ("p", "br", "div", "li", "tr", "ul") or re.fullmatch("h[1-6]", tag):
            self._end()
            self.prefix = "#" * int(tag[1]) + " " if tag[0] == "h" and len(tag) == 2 else "- " if tag == "li" else ""
        elif tag == "a":
            if "aside" in self.zone:
                self._end()
            self.link = dict(attrs).get("href") or ""
            self.now += "["

    def handle_endtag(self, tag):
        if tag == "a":
            self.now += f"]({self.link})"
        elif tag in ("nav", "aside", "header", "footer", "main", "title"):
            self._end()
            if tag in self.zone:
                self.zone.remove(tag)
        elif tag in ("p", "li", "tr", "div") or re.fullmatch("h[1-6]", tag):
            self._end()

    def handle_data(self, data):
        for k, part in enumerate(data.split("\n")):
            if k:
                self._end()
            self.now += part


@dataclass
class Model:
    line: boosting.Boosted
    block: boosting.Boosted
    dropped_pages: int = 0  # marked-up pages whose lines and labels did not fit each other


def fit(texts: list[str], urls: list[str | None], pages: list[tuple[str, str | None]] = ()) -> Model:
    """Trees for lines and blocks, from rows labelled by repetition within their sites and from marked-up pages."""
    lines = Lines.of(texts, urls)
    y = repetition_labels(lines, [host_of(u) for u in urls])
    x, z = features(lines)
    sets = [(x, y, z, lines.block, lines)]
    dropped = 0
    if pages:
        page_lines, labels = [], []
        for html, _ in pages:
            parser = _Page()
            parser.feed(html)
            parser._end()
            keep = [(a, b) for a, b in zip(parser.lines, parser.labels) if b >= 0]
            page_lines.append("\n".join(a for a, _ in keep))
            labels.append([b for _, b in keep])
        more = Lines.of(page_lines, [u for _, u in pages])
        fits = np.bincount(more.row, minlength=len(pages)) == np.array([len(x) for x in labels])
        dropped = int((~fits).sum())
        if fits.any():
            more = more.some(fits[more.row]) if len(more.row) else more
            known = np.array([b for x, ok in zip(labels, fits) if ok for b in x], np.int64)
            sets.append((*(lambda xz: (xz[0], known, xz[1]))(features(more)), more.block, more))
    x = np.vstack([s[0] for s in sets])
    y = np.concatenate([s[1] for s in sets])
    known = np.flatnonzero(y >= 0)
    if len(known) > MAX_TRAINING_LINES:
        known = known[np.random.default_rng(7).permutation(len(known))[:MAX_TRAINING_LINES]]
    long = x[known, COL["words"]] >= 7  # furniture that reads like prose is rare and counts more
    weight = np.where((y[known] == 1) & long, 4.0, 1.0)
    model_line = boosting.fit(x[known], y[known].astype(float), weight, trees=70)
    z_all, y_all, w_all = [], [], []
    for _, yy, zz, bb, _ in sets:
        if not len(bb):
            continue
        ok = yy >= 0
        bb = bb - bb[0]
        n = np.bincount(bb, ok, minlength=bb[-1] + 1)
        s = np.bincount(bb, np.where(ok, yy, 0), minlength=bb[-1] + 1)
        pure = (n > 0) & ((s == 0) | (s == n))
        z_all.append(zz[pure])
        y_all.append((s > 0)[pure])
        w_all.append(np.sqrt(n[pure]))
    model_block = boosting.fit(np.vstack(z_all), np.concatenate(y_all).astype(float), np.concatenate(w_all), trees=30)
    return Model(model_line, model_block, dropped)


def decode(line_odds: np.ndarray, block_odds: np.ndarray, block: np.ndarray, row: np.ndarray, mixed: float = 1.0, weight: float = 0.7) -> np.ndarray:
    """Whether each line is furniture, by the best labelling of blocks as furniture, body or mixed.

    A furniture block has only furniture lines and a body block only body lines; a mixed block pays a price and lets its lines
    choose. A row is never furniture only: where it would be, its likeliest body block becomes body.
    """
    if not len(block):
        return np.zeros(0, bool)
    b = block - block[0]
    odds = np.clip(line_odds, -6, 6)
    total = np.bincount(b, odds)
    best = np.bincount(b, np.abs(odds))
    score = total + weight * np.clip(block_odds, -6, 6)
    all_one, all_zero, free = score, -score, best - mixed
    choice = np.argmax(np.stack((all_zero, all_one, free)), axis=0)[b]
    hit = np.where(choice == 2, odds > 0, choice == 1)
    r = row - row[0]
    bare = np.bincount(r, ~hit) == 0
    if bare.any():
        mean = total / np.bincount(b)
        order = np.argsort(mean, kind="stable")
        of_row = r[np.flatnonzero(np.concatenate(([True], np.diff(b) != 0)))]
        likeliest = np.full(r[-1] + 1, -1)
        likeliest[of_row[order[::-1]]] = order[::-1]
        hit &= ~(bare[r] & (likeliest[r] == b))
    return hit


def predict(model: Model, lines: Lines) -> np.ndarray:
    """Whether each non-blank line is furniture."""
    if not len(lines.row):
        return np.zeros(0, bool)
    x, z = features(lines)
    return decode(model.line.predict(x), model.block.predict(z), lines.block, lines.row)


def _sample(df: DataFrame, most: int) -> list:
    """The `most` rows with the smallest _o, a hash. A bound on the hash keeps all but about twice as many rows where they are."""
    n = df.count()
    if n > 2 * most:
        df = df.where(F.col("_o") < F.lit(int(-(1 << 63) + (1 << 64) * min(1.0, 2 * most / n))))
    return df.orderBy(*df.columns).limit(most).collect()


def train(rows: DataFrame, pages: DataFrame | None, id_col: str = "rec_id", text_col: str = "text", url_col: str = "url", kind_col: str = "source_type", most_rows: int = MAX_TRAINING_ROWS, most_pages: int = MAX_TRAINING_PAGES, most_hosts: int = MAX_TRAINING_HOSTS) -> Model | None:
    """A model from at most most_rows web rows of at most most_hosts sites, and most_pages pages; all by the smallest hashes.

    Repetition can be seen only where a site has several rows in the sample, so sites come first: those with at least LEAST_SITE
    rows, all sites where there are none, each with an equal part of most_rows.
    """
    web = rows.where(F.coalesce(F.lower(F.trim(kind_col)), F.lit("")) != "pdf").where(F.length(text_col) > 0)
    picked = web.select(F.coalesce(lines_of.host(F.col(url_col)), F.lit("")).alias("h"), F.xxhash64(F.col(id_col)).alias("_o"), F.col(text_col).alias("t"), F.col(url_col).alias("u"))
    sites = picked.groupBy("h").agg(F.count("*").alias("n"))
    chosen = sites.orderBy(F.col("n") < LEAST_SITE, F.xxhash64("h"), "h").limit(most_hosts).collect()
    if not chosen:
        return None
    large = [r for r in chosen if r["n"] >= LEAST_SITE] or chosen
    each = -(-most_rows // len(large))
    bounds = {r["h"]: int(-(1 << 63) + ((1 << 64) - 1) * (2 * each / r["n"])) if 2 * each < r["n"] else (1 << 63) - 1 for r in large}
    # of each site's hashes: keeps about twice its part, so that little is ordered; a map, so that the host is found once a row
    bar = F.col("_o") <= F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair)).cast("map<string,bigint>")[F.col("h")]
    place = F.row_number().over(Window.partitionBy("h").orderBy("_o", "t"))  # of about 2 * each rows a site
    some = picked.where(bar).withColumn("place", place).where(F.col("place") <= each).orderBy("_o", "t", "u").limit(most_rows).collect()
    crawled = []
    if pages is not None:
        good = pages.where("html IS NOT NULL AND html LIKE '%<main%' AND html LIKE '%</main>%'")
        crawled = [(r["html"], r["url"]) for r in _sample(good.select(F.xxhash64("page_id").alias("_o"), "html", "url"), most_pages)]
    return fit([r["t"] for r in some], [r["u"] for r in some], crawled) if some else None


def furniture(rows: DataFrame, model: Model | None, id_col: str = "rec_id", text_col: str = "text", url_col: str = "url", kind_col: str = "source_type") -> DataFrame:
    """(id, line_no) of each furniture line of web rows. Narrow: no shuffle."""
    web = rows.where(F.coalesce(F.lower(F.trim(F.col(kind_col))), F.lit("")) != "pdf").where(F.length(text_col) > 0)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lines = Lines.of(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                hit = predict(shared.value, lines) if shared.value is not None else np.zeros(len(lines.row), bool)
                ids = batch.column(0).take(pa.array(lines.row[hit]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines.number[hit].astype(np.int32))], ["id", "line_no"])

    return web.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(url_col).cast("string").alias("u")).mapInArrow(run, "id long, line_no int")


def main_bodies(rows: DataFrame, model: Model | None, id_col: str = "rec_id", text_col: str = "text", url_col: str = "url", kind_col: str = "source_type") -> DataFrame:
    """(id, body): each row's text without furniture lines; texts of pdf rows are left as they are, null stays null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts, web = batch.column(1).to_pylist(), batch.column(3).to_pylist()
                lines = Lines.of([t if w else None for t, w in zip(texts, web)], batch.column(2).to_pylist())
                hit = predict(shared.value, lines) if shared.value is not None else np.zeros(len(lines.row), bool)
                drop: dict[int, set[int]] = {}
                for r, k in zip(lines.row[hit].tolist(), lines.number[hit].tolist()):
                    drop.setdefault(r, set()).add(k)
                body = [t if i not in drop else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]).strip("\n") for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.string())], ["id", "body"])

    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(url_col).cast("string").alias("u"), (F.coalesce(F.lower(F.trim(F.col(kind_col))), F.lit("")) != "pdf").alias("web"))
    return picked.mapInArrow(run, "id long, body string")
