import os

import duckdb
import pandas as pd
import pytest

from textloom.llm.oracles import ORACLES
from textloom.llm.queries import QUERIES


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.sql(ORACLES[name]).df())


def test_pieces_keep_their_promises(spark, sf):
    """Sizes, cover and overlaps of p6_pieces, stated in SQL over its rows and the texts."""
    found = QUERIES["p6_pieces"](spark, sf).toPandas()
    con = duckdb.connect()
    con.register("pieces", found)
    for name in ("combined_campus_data", "campus_pdfs"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    bad = con.sql("""
WITH texts AS (SELECT 'combined_campus_data' AS table_name, rec_id, text FROM combined_campus_data UNION ALL SELECT 'campus_pdfs', rec_id, text FROM campus_pdfs),
p AS (SELECT p.*, text, lead("start") OVER w AS following, lead("end") OVER w AS following_end, row_number() OVER w AS n FROM pieces p JOIN texts USING (table_name, rec_id) WINDOW w AS (PARTITION BY table_name, rec_id ORDER BY piece_no))
SELECT * FROM p WHERE length(piece) > 2000 OR piece <> substring(text, CAST("start" + 1 AS BIGINT), CAST("end" - "start" AS BIGINT)) OR (n = 1 AND "start" <> 0) OR (following IS NULL AND "end" <> length(text))
  OR following > "end" OR "end" - following > 200 OR following <= "start" OR following_end <= "end" """).df()
    assert len(bad) == 0
