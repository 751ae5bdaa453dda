"""Carried-anchor reconciliation against a fold over all rows in order."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlake import scan_queries
from ledgerlake.operators import anchors


def statement(rng: random.Random, n: int) -> list[tuple]:
    """Rows (seq, balance, amount) in cents with foreign lines, misread figures and gaps."""
    at, out = rng.randrange(10_000, 90_000), []
    for seq in range(n):
        kind = rng.random()
        if kind < 0.12:
            out.append((seq, rng.randrange(0, 100_000), rng.randrange(1, 5_000)))
            continue
        if kind < 0.16:
            out.append((seq, None if kind < 0.14 else at, rng.randrange(1, 5_000) if kind < 0.14 else None))
            continue
        amount = rng.choice([100, 250, 900, rng.randrange(1, 5_000)])
        before = at
        at += amount if rng.random() < 0.5 else -amount
        if kind < 0.17:  # a step that nobody sees
            continue
        out.append((seq, at + rng.choice([0, 0, 0, 3, -5, 9]) if kind < 0.9 else before, amount))
    return out


def folded(rows: list[tuple], opening: int | None) -> list[str]:
    rows = sorted(rows)
    anchor = opening if opening is not None else next((b for _, b, _ in rows if b is not None), None)
    return anchors.fold([b for _, b, _ in rows], [a for _, _, a in rows], anchor, 5)


@pytest.mark.parametrize("bucket", [3, 16, 1 << 16])
def test_carried_anchor_equals_a_fold(spark, bucket):
    rng = random.Random(bucket)
    data, want = [], {}
    for account in range(12):
        rows = statement(rng, 150)
        opening = None if account % 3 == 0 else rng.choice([rows[0][1] or 0, 12_345, next(b for _, b, _ in rows if b is not None)])
        want.update({(account, s): x for (s, _, _), x in zip(sorted(rows), folded(rows, opening))})
        data += [(account, s, None if b is None else b / 100, None if a is None else a / 100, None if opening is None else opening / 100) for s, b, a in rows]
    df = spark.createDataFrame(data, "account_id long, seq long, balance double, amount double, opening double").withColumn("status2", F.lit("kept"))
    got = anchors.reconcile_carried(df, F.col("opening"), bucket_rows=bucket).collect()
    assert {(r["account_id"], r["seq"]): r["status"] for r in got} == want and len(got) == len(data)
    assert {"deposit", "withdrawal", "skipped", "unread"} <= set(want.values()) and got[0]["status2"] == "kept"


def test_noise_between_rows_does_not_move_the_anchor(spark):
    rows = [(1, 0, 110.0, 10.0), (1, 1, 999.0, 1.0), (1, 2, 90.0, 20.0), (1, 3, None, 5.0), (1, 4, 95.0, 5.0)]
    df = spark.createDataFrame(rows, "account_id long, seq long, balance double, amount double")
    got = anchors.reconcile_carried(df, F.lit(100.0), bucket_rows=2)
    assert [r["status"] for r in got.orderBy("seq").collect()] == ["deposit", "skipped", "withdrawal", "unread", "deposit"]
    counts = anchors.skipped_counts(got).first()
    assert (counts["n_rows"], counts["n_accepted"], counts["n_skipped"], counts["n_unread"]) == (5, 3, 1, 1)
    assert anchors.reconcile_carried(df.limit(0), F.lit(1.0)).count() == 0


def test_foreign_lines_are_skipped_whatever_the_amount(spark):
    """A row of 999.87 explains a line that is off by 1000.37 with 0.50 added to the amount."""
    rows, balance = [], 0
    for k in range(1, 30):
        amount = 99987 if k in (7, 21) else 5000 + k
        balance += amount
        rows.append((2, k, balance / 100, amount / 100))
    df = spark.createDataFrame(rows, "account_id long, seq long, balance double, amount double")
    df = df.select("account_id", "seq", F.col("balance").cast("decimal(18,2)").alias("balance"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    got = anchors.skipped_counts(anchors.reconcile_carried(scan_queries.foreign_rows(df), F.col("opening"))).first()
    assert (got["n_rows"], got["n_accepted"], got["n_skipped"], got["n_unread"]) == (33, 29, 4, 0)
