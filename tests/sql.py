"""Registered queries against their SQL in DuckDB."""

import duckdb

import __spark_entry__ as entry
from check import rows

TABLES = ["events", "orders"]


def assert_equals_sql(spark, name, sf):
    """Same columns and same rows, floats to ten digits."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, rel.fetchall())
