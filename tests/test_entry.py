"""The driver contract: entry, queries, reference SQL; a few queries compared on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = ["events", "orders"]


def test_names_and_sql_agree():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and len(names) >= 136


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 54


@pytest.mark.parametrize("name", ["nfv3_volume", "cic_flags", "alert_counters", "split_fewshot", "auroc_binary",
                                  "flow_session_window", "protocol_eval", "ip_rules_active"])
def test_small_data_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = sorted(map(str, (tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rel.fetchall())))
    df = entry.queries()[name](spark, SMALL).select(names)
    got = sorted(map(str, (tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in df.collect())))
    assert got == want
