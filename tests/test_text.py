import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions.strings import split_lines, strip
from textloom.operators import text
from textloom.rules import DEFAULT_SITE, pdf_noise, web_boilerplate


def values(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_strip_knows_unicode_and_separators(spark):
    rows = [" a ", "\t\na\x1c\x1f", " a b ", "", None, "\x85x\x85", "a\n"]
    assert values(spark, rows, strip) == [None if r is None else r.strip() for r in rows]


def test_lines_split_like_splitlines(spark):
    rows = ["a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "a", "x\n\ny"]
    assert values(spark, rows, split_lines) == [r.splitlines() for r in rows]


def reference_lines(t):
    out, before = [], None
    for line in t.splitlines():
        s = line.strip()
        if s:
            if s != before:
                out.append(line)
            before = s
    return "\n".join(out).strip()


def test_repeated_neighbours(spark):
    rows = ["a\nb\n\na", "a\n a \nb\nb\n\na", "", None, "\n\n", "x\n\n  x\ny"]
    assert values(spark, rows, text.normalise_lines) == [None if r is None else reference_lines(r) for r in rows]
    assert values(spark, ["a\n\n a \nb\nb\n\na"], text.normalise_lines) == ["a\nb\na"]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n\t\r\x0b", max_size=30), min_size=1, max_size=8))
def test_normalise_lines_is_stable(spark, rows):
    once = values(spark, rows, text.normalise_lines)
    assert once == [reference_lines(r) for r in rows]
    assert values(spark, once, text.normalise_lines) == once


def test_patterns_agree_with_python(spark):
    site = DEFAULT_SITE
    rows = [
        f"Top {site.short} uses cookies on this website. More\nand more", "A This website uses cookies! x\ny Accept B", f"{site.name}\n{site.street} | {site.town} Phone: {site.phone} end",
        f"© 2024 {site.name}. All rights reserved. z", "[Skip to main content](#a) TOGGLE NAVIGATION ↑  top", "* [Prospective Students] gone\nall", "Loading - JavaScript", "plain",
    ]
    expected = []
    for r in rows:
        for p in web_boilerplate():
            r = re.sub(p, "", r, flags=re.S | re.I | re.M)
        expected.append(r)
    assert values(spark, rows, text.remove_web_boilerplate) == expected
    pdf = [f"x {site.short} Catalog 2024-2025 y Page 3 of ٣ z", "a Printed on: 1/2 rest\nnext 12", "Generated from  this", f"www.{site.domain} 42 \n", f"{site.name.upper()} t"]
    expected = []
    for r in pdf:
        for p in pdf_noise():
            r = re.sub(p, "", r, flags=re.I)
        expected.append(r)
    assert values(spark, pdf, text.remove_pdf_noise) == expected


def test_pdf_clean(spark):
    assert values(spark, ["a  b\n\n\n\nc\n12\n1234x", None, "", "7"], text.clean_pdf) == ["a b\n\nc\n1234x", None, "", ""]


def test_web_clean_of_null_is_empty(spark):
    assert values(spark, [None, ""], text.clean_web) == ["", ""]


@pytest.mark.parametrize("blocks,expected", [([(0, [["a", "b"], ["c"]]), (1, [["x"]])], "a b c"), ([], "")])
def test_page_text(spark, blocks, expected):
    tree = [{"type": k, "lines": [{"spans": [{"text": s} for s in spans]} for spans in lines]} for k, lines in blocks]
    df = spark.createDataFrame([(tree,)], "b array<struct<type:int,lines:array<struct<spans:array<struct<text:string>>>>>>")
    assert df.select(text.page_text(F.col("b"))).first()[0] == expected


def test_page_numbers_of_any_digits(spark):
    rows = [("a\n 12 \n²³\n①\n1234\n٣\nx1",)]
    assert spark.createDataFrame(rows, "t string").select(text.drop_page_numbers(F.col("t"))).first()[0] == "a\n1234\nx1"
