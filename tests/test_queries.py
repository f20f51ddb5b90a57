"""Every registered query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from featsel.jobs.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("lineitem", "orders", "customer", "documents", "events", "nation"):
            con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
        out = con.sql(ORACLES[name])
        assert sorted(out.columns) == sorted(df.columns)
        want = sorted(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in sorted(df.columns))} from ({ORACLES[name]})").fetchall(), key=str)
        assert len(got) == len(want)
        assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b)), [(a, b) for a, b in zip(got, want) if a != b][:3]


def test_entry(spark):
    assert entry.entry(spark).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())
