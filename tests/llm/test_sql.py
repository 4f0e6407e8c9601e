"""The SQL of the corpus queries against the queries."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, str(DATA))
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(result.fetchall())
