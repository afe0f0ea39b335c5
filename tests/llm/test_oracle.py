"""The queries that have SQL against it, on the smallest tables."""

import duckdb
import pytest

from lumenfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(queries.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    want = relation.select(*columns).fetchall()
    assert len(want) > 0
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)
