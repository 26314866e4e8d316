"""Every registered query with SQL against DuckDB; the llm ones are tested in their own folder."""

from pathlib import Path

import duckdb
import pytest

from tidewater import queries

DATA = "/root/testdata/sf0.001"


def compare(spark, run, sql, data=DATA):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = run(spark, data)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
