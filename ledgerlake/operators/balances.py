"""Sides and transactions from running balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .prefix import keyed, running, unkeyed

BUCKET_ROWS = 1 << 16
DEPOSIT_WORDS = r"\b(CR|CREDIT|DEPOSIT)\b|RTGS CR|FT - CR"
WITHDRAWAL_WORDS = r"\b(DR|DEBIT|WITHDRAWAL|CBDT)\b|NEFT DR"


def bucket_of(seq: Column) -> Column:
    return F.floor(seq / BUCKET_ROWS)


def with_neighbour(rows: DataFrame, keys: tuple[str, ...], ahead: bool, name: str) -> DataFrame:
    """Adds the balance of the row before (or ahead) by seq, as ``name``.

    An account's rows are cut into buckets by seq, so that it spreads over tasks;
    only the last (first) balance of each bucket goes through a window over the
    whole account."""
    cut, found = keyed(rows, {k: F.col(k) for k in keys})
    cut = cut.withColumn("_b", bucket_of(F.col("seq")))
    by = [q for k in keys for q in found[k]]
    given = {k: rows.schema[k].dataType for k in keys if len(found[k]) == 2}
    inside = Window.partitionBy(*by, "_b").orderBy("seq")
    edge = F.min_by if ahead else F.max_by
    edges = cut.groupBy(*by, "_b").agg(edge(F.struct("balance"), "seq").alias("_e"))
    over = Window.partitionBy(*by).orderBy("_b")
    step = F.lead if ahead else F.lag
    edges = edges.select(*by, "_b", step("_e.balance").over(over).alias("_next"))
    near = cut.withColumn("_near", step(F.struct("balance")).over(inside)).drop(*given)
    value = F.when(F.col("_near").isNull(), F.col("_next")).otherwise(F.col("_near.balance"))
    shown = [unkeyed(x, found[x], given[x]) if x in given else F.col(x) for x in rows.columns]
    return near.join(edges, [*by, "_b"]).select(*shown, value.alias(name))


def numbered(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Adds the row number by seq, over the same buckets."""
    return running(rows, list(keys), bucket_of(F.col("seq")), ["seq"], name, {})


def infer_side(rows: DataFrame, keys: tuple[str, ...] = ("account_id",), tolerance: float = 0.02) -> DataFrame:
    """Which side an amount belongs to, from the change of the balance, then
    from words; deposit if nothing tells."""
    change = F.col("balance") - F.col("_before")
    text = F.upper("narration")
    side = (
        F.when(F.abs(change - F.col("amount")) <= tolerance, "deposit")
        .when(F.abs(change + F.col("amount")) <= tolerance, "withdrawal")
        .when(text.rlike(DEPOSIT_WORDS), "deposit")
        .when(text.rlike(WITHDRAWAL_WORDS), "withdrawal")
        .otherwise("deposit")
    )
    return with_neighbour(rows, keys, False, "_before").withColumn("side", side).drop("_before")


def side_of_next(rows: DataFrame, keys: tuple[str, ...] = ("account_id",), tolerance: float = 0.02) -> DataFrame:
    """For rows listed newest first: the change against the next row's balance
    gives side and amount; without a next row the printed sides stay."""
    change = F.col("balance") - F.col("_after")
    small = F.abs(change) < tolerance
    none = F.lit(None).cast("decimal(18,2)")
    return with_neighbour(rows, keys, True, "_after").withColumn("_change", change.cast("decimal(18,2)")).select(
        *rows.columns,
        F.when(F.col("_change").isNull(), F.col("debit")).when(small, none).when(F.col("_change") < 0, -F.col("_change")).alias("withdrawal"),
        F.when(F.col("_change").isNull(), F.col("credit")).when(small, none).when(F.col("_change") > 0, F.col("_change")).alias("deposit"),
    )


def reconcile_running(rows: DataFrame, opening: Column, keys: tuple[str, ...] = ("account_id",), tolerance: float = 0.05) -> DataFrame:
    """Accepts a row if its amount explains the balance against the row before
    (the opening balance for the first); every row re-anchors."""
    before = F.coalesce("_before", opening)
    change = F.col("balance") - before
    status = F.when(F.abs(change - F.col("amount")) <= tolerance, "deposit").when(F.abs(change + F.col("amount")) <= tolerance, "withdrawal")
    return with_neighbour(rows, keys, False, "_before").withColumn("status", F.coalesce(status, F.lit("skipped"))).drop("_before")


def chain_mismatches(rows: DataFrame, keys: tuple[str, ...] = ("account_id",), tolerance: float = 0.02) -> DataFrame:
    """Rows, newest first, whose sides do not explain the step to the next balance."""
    change = F.col("balance") - F.col("_after")
    net = F.col("credit") - F.col("debit")
    marked = with_neighbour(rows, keys, True, "_after").withColumn("_wrong", change.isNotNull() & (F.abs(change - net) > tolerance))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_wrong").alias("n_mismatches"))


def from_balances(rows: DataFrame, keys: tuple[str, ...] = ("account_id",), least: float = 0.01) -> DataFrame:
    """One transaction per change between balances that follow each other; the
    k-th takes the k-th date, the last date for all beyond."""
    change = (F.col("balance") - F.col("_before")).cast("decimal(18,2)")
    steps = with_neighbour(rows.select(*keys, "seq", "balance"), keys, False, "_before").select(*keys, "seq", change.alias("change")).filter(F.abs("change") >= least)
    steps = written(steps, "balance-steps")  # numbered from here, not from the rows again
    dates = numbered(rows.select(*keys, "seq", "txn_date"), keys, "k").select(*keys, "k", "txn_date")
    zero = F.lit(0).cast("decimal(18,2)")
    # steps are some of the rows, so each number has a date
    return numbered(steps, keys, "k").join(dates, [*keys, "k"]).select(
        *keys, "seq", "txn_date", F.greatest(-F.col("change"), zero).alias("withdrawal"), F.greatest(F.col("change"), zero).alias("deposit")
    )
