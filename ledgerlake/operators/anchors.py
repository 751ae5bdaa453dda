"""Reconciliation against an anchor that moves on accepted rows only.

Rows of a scanned statement are noisy: a misread balance or a foreign line is no
base to judge the next row by.  Here the anchor is the balance of the last accepted
row (at first the opening balance); a row is accepted if its balance is the anchor plus or
minus its amount.  A rejected row leaves the anchor as it is.

The anchor that reaches a row depends on all rows before it, and not by a sum, so
no window gives it.  A stretch of rows, though, is a small function from the
anchor that enters to the one that leaves, and such functions can be put
together in any order:

1. An account is cut into buckets.  In a bucket, each row has a next row: the first
   later one that accepts its balance as the anchor; following these, each row has the
   balance with which the bucket is left once the row is accepted (its exit).
   Many rows share an exit, so the bucket's function has few values.
2. An exit enters the first row of any later bucket that accepts it.  One
   ordered window over the points at which rows accept finds it, for all exits at once.
3. Exits and what they lead to are a forest with one step per bucket.  The path
   from the opening balance is found by doubling the steps: as many rounds as the number
   of buckets has binary digits.
4. Each bucket on the path is folded with the anchor that enters it.

So an account of any size spreads over tasks; a task holds one bucket.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .balances import BUCKET_ROWS

DEPOSIT, WITHDRAWAL, SKIPPED, UNREAD = "deposit", "withdrawal", "skipped", "unread"


def cents(x: Column) -> Column:
    return F.round(x.cast("decimal(20,4)") * 100).cast("long")


def exits(balance: np.ndarray, amount: np.ndarray, tolerance: int) -> np.ndarray:
    """For each row, once accepted, the balance of the last row accepted after it."""
    first: dict[int, int] = {}
    out = balance.copy()
    for r in range(len(balance) - 1, -1, -1):
        b, a = int(balance[r]), int(amount[r])
        after = first.get(b)
        if after is not None:
            out[r] = out[after]
        for point in {b - a, b + a}:
            for near in range(point - tolerance, point + tolerance + 1):
                first[near] = r
    return out


def fold(balance: list[int | None], amount: list[int | None], anchor: int | None, tolerance: int) -> list[str]:
    """What each row is, one after the other, from an anchor (null: none reaches here)."""
    out = []
    for b, a in zip(balance, amount):
        if b is None or a is None:
            out.append(UNREAD)
        elif anchor is not None and abs(b - anchor - a) <= tolerance:
            out.append(DEPOSIT)
            anchor = b
        elif anchor is not None and abs(b - anchor + a) <= tolerance:
            out.append(WITHDRAWAL)
            anchor = b
        else:
            out.append(SKIPPED)
    return out


def first_balances(rows: DataFrame) -> DataFrame:
    """(_a, anchor): without a printed opening balance the first balance of the account is it."""
    return rows.filter("_balance IS NOT NULL").groupBy("_a").agg(F.min_by("_balance", "_seq").alias("anchor"))


def path_of(opening: DataFrame, points: DataFrame, leaving: DataFrame, tolerance: int) -> DataFrame:
    """(_a, _b, anchor): the anchor that enters each bucket in which it is accepted."""
    start = opening.select("_a", F.lit(-1).cast("long").alias("_b"), "anchor")
    nodes = written(leaving.select("_a", "_b", F.col("exit").alias("anchor")).distinct().unionByName(start), "anchor-exits")
    asked = nodes.select("_a", F.explode(F.sequence(F.col("anchor") - tolerance, F.col("anchor") + tolerance)).alias("point"), F.col("_b").alias("at"), "anchor")
    known = points.join(asked.select("_a", "point").distinct(), ["_a", "point"], "left_semi")
    known = known.select("_a", "point", F.col("_b").alias("at"), F.lit(None).cast("long").alias("anchor"), F.struct("_b", "_seq", "exit").alias("row"))
    both = known.unionByName(asked.withColumn("row", F.lit(None).cast(known.schema["row"].dataType)))
    later = Window.partitionBy("_a", "point").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    met = both.withColumn("next", F.min("row").over(later)).filter("anchor IS NOT NULL AND next IS NOT NULL")
    step = met.groupBy("_a", F.col("at").alias("_b"), "anchor").agg(F.min("next").alias("next"))
    steps = [written(step.select("_a", "_b", "anchor", F.col("next._b").alias("to_b"), F.col("next.exit").alias("to_anchor")), "anchor-steps")]
    n_buckets = nodes.agg(F.max(F.struct("_b"))).first()[0]
    reach = 1
    while n_buckets is not None and reach <= n_buckets[0] + 1:
        one = steps[-1]
        two = one.select("_a", F.col("_b").alias("to_b"), F.col("anchor").alias("to_anchor"), F.col("to_b").alias("b2"), F.col("to_anchor").alias("anchor2"))
        two = one.join(two, ["_a", "to_b", "to_anchor"]).select("_a", "_b", "anchor", F.col("b2").alias("to_b"), F.col("anchor2").alias("to_anchor"))
        steps.append(written(two, "anchor-steps"))
        reach *= 2
    found = start
    for step in reversed(steps):
        reached = found.join(step, ["_a", "_b", "anchor"]).select("_a", F.col("to_b").alias("_b"), F.col("to_anchor").alias("anchor"))
        found = written(found.unionByName(reached), "anchor-path")
    return found.join(steps[0], ["_a", "_b", "anchor"]).select("_a", F.col("to_b").alias("_b"), "anchor")


def reconcile_carried(
    rows: DataFrame,
    opening: Column | None = None,
    keys: tuple[str, ...] = ("account_id",),
    tolerance: float = 0.05,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adds ``status``: deposit or withdrawal for accepted rows, skipped for rows that do
    not follow from the anchor, unread for rows without a balance or an amount.

    rows: keys, seq, balance, amount.  opening is a column over rows (the value at the
    first row of an account counts); where it is null, or not given, the first balance
    of the account is the anchor, and its own row so is skipped unless its amount is zero.
    """
    near = round(tolerance * 100)
    base = rows.select(
        F.struct(*keys).alias("_a"),
        F.col("seq").cast("long").alias("_seq"),
        cents(F.col("balance")).alias("_balance"),
        cents(F.col("amount")).alias("_amount"),
        (cents(opening) if opening is not None else F.lit(None).cast("long")).alias("_opening"),
    )
    base = written(base.withColumn("_b", F.floor(F.col("_seq") / bucket_rows)), "anchor-rows")
    given = base.groupBy("_a").agg(F.min_by("_opening", "_seq").alias("given"))
    opened = given.join(first_balances(base), "_a", "left").select("_a", F.coalesce("given", "anchor").alias("anchor")).filter("anchor IS NOT NULL")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq", kind="stable")
        pdf["exit"] = exits(pdf["_balance"].to_numpy(np.int64), pdf["_amount"].to_numpy(np.int64), near)
        return pdf[["_a", "_b", "_seq", "_balance", "_amount", "exit"]]

    kind = base.schema["_a"].dataType.simpleString()
    read = base.filter("_balance IS NOT NULL AND _amount IS NOT NULL").select("_a", "_b", "_seq", "_balance", "_amount")
    known = read.groupBy("_a", "_b").applyInPandas(leave, f"_a {kind}, _b long, _seq long, _balance long, _amount long, exit long")
    known = written(known, "anchor-known")
    points = known.select("_a", "_b", "_seq", "exit", F.explode(F.array_distinct(F.array(F.col("_balance") - F.col("_amount"), F.col("_balance") + F.col("_amount")))).alias("point"))
    entering = path_of(opened, points, known, near)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq", kind="stable")
        whole = lambda c: [None if pd.isna(x) else int(x) for x in pdf[c]]
        anchor = whole("anchor")[0]
        pdf["status"] = fold(whole("_balance"), whole("_amount"), anchor, near)
        return pdf[["_a", "_seq", "status"]]

    judged = base.join(entering, ["_a", "_b"], "left").select("_a", "_b", "_seq", "_balance", "_amount", "anchor")
    judged = judged.groupBy("_a", "_b").applyInPandas(judge, f"_a {kind}, _seq long, status string")
    judged = judged.select(F.col("_a").alias("_a2"), F.col("_seq").alias("_s2"), "status")
    return rows.join(judged, (F.struct(*[F.col(k) for k in keys]) == F.col("_a2")) & (F.col("seq") == F.col("_s2"))).drop("_a2", "_s2")


def skipped_counts(judged: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Per account: rows found, accepted, skipped and unread."""
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("status").isin(DEPOSIT, WITHDRAWAL)).alias("n_accepted"),
        F.count_if(F.col("status") == SKIPPED).alias("n_skipped"),
        F.count_if(F.col("status") == UNREAD).alias("n_unread"),
    )
