"""The driver contract: names, schema, every query runs and agrees with its SQL."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TALLYARD_TEST_DATA", "/root/testdata/sf0.001")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.schema == entry.entry(spark).schema


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert len(columns) == len(set(columns))
    rows = df.select(*columns).collect()
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.execute("SET timezone='UTC'")
        for file in os.listdir(DATA):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
        found = con.execute(sql)
        heads = [c[0] for c in found.description]
        assert sorted(heads) == columns
        other = [tuple(plain(r[heads.index(c)]) for c in columns) for r in found.fetchall()]
        assert sorted((tuple(plain(v) for v in r) for r in rows), key=str) == sorted(other, key=str)


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
