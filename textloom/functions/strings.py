"""Strings as Unicode text: strip, lines, and regular expressions with Unicode classes.

Patterns are written once, in the dialect that Java, RE2 and Python share, and get their flags here: for web text the dot matches
everything and case, lines and classes follow Unicode; for PDF text the dot stops at a line feed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WEB_FLAGS, PDF_FLAGS = "(?dsmiU)", "(?diU)"
SPACE = r"[\s\x1c-\x1f]"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def totalled(items: Column, name: str) -> Column:
    """items as structs of their number and the item, so that one generator gives both and the items are evaluated once."""
    return let(items, lambda all_: F.transform(all_, lambda x: F.struct(F.size(all_).alias("total"), x.alias(name))))


def strip(x: Column) -> Column:
    """x without white space at both ends; tabs, line ends and the separators U+001C to U+001F count."""
    return F.regexp_replace(x, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def split_lines(x: Column) -> Column:
    """Lines of x, split at all ten line terminators and CRLF. A final terminator leaves an empty last line."""
    return F.split(x, LINE_ENDS, -1)


def blank(x: Column) -> Column:
    return strip(x) == ""


def contains_any(x: Column, needles: Iterable[str]) -> Column:
    """Whether x holds one of the needles; false for no needles, null for a null x."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(x, F.lit(n))
    return F.when(x.isNotNull(), out)


def first_containing(x: Column, rules: Iterable[tuple[str, Iterable[str]]], default: str | None) -> Column:
    """Name of the first rule one of whose needles x holds, in the order of the rules."""
    out = None
    for name, needles in rules:
        hit = contains_any(x, needles)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def remove_all(x: Column, patterns: Iterable[str], flags: str) -> Column:
    """x with the matches of each pattern removed, one after the other."""
    for p in patterns:
        x = F.regexp_replace(x, flags + p, "")
    return x
