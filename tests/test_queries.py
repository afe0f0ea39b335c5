"""Each query against its SQL; those without have a test of their own elsewhere, and rows."""

import math

import duckdb
import pytest

from lumenfold import file_queries, queries, registry, signal_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
#: No signal of the smallest tables is long enough for a spectrum or a lost packet; figures of sessions are looked at where there are many.
LONGER = dict.fromkeys(["power_density", "capture_gaps", "spectrograms", "recording_states", "recovered_exponents", "session_summary", "running_moments"], "/root/testdata/sf0.01")


def plain(rows):
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 3) + 0.0
        return x if x is None or isinstance(x, (int, bool)) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    def connect(folder):
        con = duckdb.connect()
        for t in ("events", "embeddings", "lineitem", "orders", "nation", "region", "supplier"):
            con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
        return con

    return connect


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    folder = LONGER.get(name, SF)
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    assert got
    if name in registry.ORACLE_SQL:
        relation = duck(folder).sql(registry.ORACLE_SQL[name])
        assert sorted(relation.columns) == columns
        want = relation.select(*(f'"{c}"' for c in columns)).fetchall()
        assert plain(got) == plain(want)
