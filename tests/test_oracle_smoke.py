"""Spark result == DuckDB oracle for representative queries at sf0.001 (fast twin of the driver gate)."""

import duckdb
import pytest

import __spark_entry__ as E
from ledgerlens import bind
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
NAMES = ["ledger_accounts_v1", "ledger_v2", "validate_contract", "transition_fit", "cramers_v", "enforce_order",
         "asof_last", "rate_violations", "stream_ledger", "expand_sequences", "top_fraction", "label_size"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in bind.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, rows)[0] == digest(cols, cur.fetchall())[0]
