"""The corpus queries that have SQL give DuckDB's rows."""

import duckdb
import pytest

queries = pytest.importorskip("lectern.llm.queries")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    found = queries.queries()[name](spark, small)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in found.collect()), key=repr) == want and want
