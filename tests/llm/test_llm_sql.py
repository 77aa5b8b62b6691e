import os
import sys

import duckdb
import pytest

from keystrata.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from test_catalogue import table  # noqa: E402

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = queries.queries()[name](spark, sf)
    c = con.execute(SQL[name])
    want = table([d[0] for d in c.description], c.fetchall())
    assert table(df.columns, df.collect()) == want
    if name == "near_vectors_loose":
        assert sum(r[1] > 0 for r in want[1]) > 0  # links
