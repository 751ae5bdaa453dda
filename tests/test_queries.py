"""Every registered query with a SQL twin against DuckDB, and the entry."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlake import history_queries, queries, rule_queries, scan_queries, zip_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def comparable(rows):
    out = []
    for r in rows:
        out.append(tuple("~" if v is None else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert comparable(df.collect()) == comparable(want)


def test_entry_and_registries(spark):
    assert entry.entry(spark).count() == 3133
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_party_ledger_keeps_sums(spark):
    rows = queries.QUERIES["party_ledger_full"](spark, SF).collect()
    facts = queries.transactions(spark, SF).collect()
    assert sum(r["txn_count"] for r in rows) == len(facts)
    assert abs(sum(r["debit"] for r in rows) - float(sum(f["debit"] for f in facts))) < 0.01
    assert {r["party_type"] for r in rows} <= {"person", "merchant", "bank_system", "charge", "self", "unrecognized"}
