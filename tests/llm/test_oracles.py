"""The SQL of the corpus operators, on the same tables."""

import duckdb
import pytest

from wayfold.llm import queries


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    expected = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected.fetchall(), key=repr) and found
