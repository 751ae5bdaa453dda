"""Circular flows: every pair of money in and money out within the days, none twice."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from ledgerlake.plans import modules


def test_every_pair_is_found_once(spark, monkeypatch):
    rows = [(1, k, date(2024, 1, 1) + timedelta(days=(k * 5) % 23), float(k) if k % 2 else 0.0, 0.0 if k % 2 else float(k), "AB"[k % 3 == 0]) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "account_id long, seq long, txn_date date, credit double, debit double, filed_party string")
    df = df.withColumns({x: F.col(x).cast("decimal(18,2)") for x in ("credit", "debit")})
    monkeypatch.setattr(modules, "party_rows", lambda t: t)
    got = sorted((r["in_seq"], r["out_seq"], r["days"]) for r in modules.circular_flows(df).collect())
    assert got == sorted((i[1], o[1], (o[2] - i[2]).days) for i in rows for o in rows if i[3] > 0 and o[4] > 0 and i[5] == o[5] and 0 <= (o[2] - i[2]).days <= 7)
    assert len(got) > 100
