import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from textloom.plans import oracles as core_oracles

CORE = sorted(core_oracles.ORACLES)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([None if not isinstance(v, (list, dict)) and pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def test_entry(spark, sf):
    assert contract.entry(spark).count() == 5


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    assert rows(contract.queries()[name](spark, sf).toPandas()) == rows(con.sql(contract.oracle_sql()[name]).df())


def test_core_does_not_import_the_training_operators():
    import pathlib

    root = pathlib.Path(contract.__file__).parent / "textloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "textloom.llm" not in f.read_text()
