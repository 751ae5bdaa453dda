"""Month metrics, daily flow and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round2


def dbl(c: Column) -> Column:
    return c.cast("double")


def month_metrics(txns: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Per month: opening and closing balance, totals, counts, cash and UPI
    parts, mean balance.  First and last are those by seq; a null balance of the
    first row opens at 0, one of the last row closes at opening + net."""
    credit, debit, balance = F.col("credit"), F.col("debit"), F.col("balance")
    first = F.min_by(F.struct("balance", "credit", "debit"), "seq")
    last = F.max_by(F.struct("balance"), "seq")
    part = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    grouped = txns.groupBy(*keys, "month_key").agg(
        first.alias("f"),
        last.alias("l"),
        F.min("month").alias("month"),
        F.sum("credit").alias("credits"),
        F.sum("debit").alias("debits"),
        F.count_if(credit > 0).alias("credit_count"),
        F.count_if(debit > 0).alias("debit_count"),
        part(F.col("category") == "Cash Deposit", credit).alias("cash_deposit"),
        part(F.col("category") == "Cash Withdrawal", debit).alias("cash_withdrawal"),
        part(F.col("mode") == "UPI", credit).alias("upi_credit"),
        part(F.col("mode") == "UPI", debit).alias("upi_debit"),
        F.sum("balance").alias("balance_sum"),
        F.count("balance").alias("balance_n"),
    )
    opening = F.when(F.col("f.balance").isNull(), F.lit(0)).otherwise(F.col("f.balance") - F.col("f.credit") + F.col("f.debit"))
    closing = F.coalesce(F.col("l.balance"), opening + F.col("credits") - F.col("debits"))
    mean = F.when(F.col("balance_n") > 0, dbl(F.col("balance_sum")) / F.col("balance_n")).otherwise(0.0)
    return grouped.select(
        *keys,
        "month_key",
        "month",
        dbl(opening).alias("opening_balance"),
        dbl(closing).alias("closing_balance"),
        dbl(F.col("credits")).alias("total_credits"),
        dbl(F.col("debits")).alias("total_debits"),
        dbl(F.col("credits") - F.col("debits")).alias("net"),
        "credit_count",
        "debit_count",
        dbl(F.col("cash_deposit")).alias("cash_deposit"),
        dbl(F.col("cash_withdrawal")).alias("cash_withdrawal"),
        dbl(F.col("upi_credit")).alias("upi_credit"),
        dbl(F.col("upi_debit")).alias("upi_debit"),
        round2(mean).alias("mean_balance"),
    )


def daily_flow(txns: DataFrame, month_key: str, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    return (
        txns.filter(F.col("month_key") == month_key)
        .groupBy(*keys, F.date_format("txn_date", "yyyy-MM-dd").alias("day"))
        .agg(F.sum("credit").alias("c"), F.sum("debit").alias("d"), F.count(F.lit(1)).alias("txn_count"))
        .select(*keys, "day", dbl(F.col("c")).alias("credits"), dbl(F.col("d")).alias("debits"), dbl(F.col("c") - F.col("d")).alias("net"), "txn_count")
    )


def totals_of_months(months: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """First opening, last closing and sums over the months of an account."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return months.groupBy(*keys).agg(
        F.min_by("opening_balance", "month_key").alias("opening_balance"),
        F.max_by("closing_balance", "month_key").alias("closing_balance"),
        dbl(money("total_credits")).alias("total_credits"),
        dbl(money("total_debits")).alias("total_debits"),
        F.sum("credit_count").alias("credit_count"),
        F.sum("debit_count").alias("debit_count"),
        F.count_if(F.col("net") < 0).alias("negative_months"),
        F.count(F.lit(1)).alias("n_months"),
    )


def statement_totals(txns: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Calculated totals of a statement: both sides and the last balance."""
    return txns.groupBy(*keys).agg(
        dbl(F.sum("debit")).alias("withdrawal"), dbl(F.sum("credit")).alias("deposit"), dbl(F.max_by("balance", "seq")).alias("closing_balance")
    )


def statement_period(txns: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("-"))
    return txns.groupBy(*keys).agg(F.min("txn_date").alias("a"), F.max("txn_date").alias("b")).select(
        *keys, text("a").alias("period_from"), text("b").alias("period_to")
    )


def reconciled(calculated: DataFrame, printed: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Calculated against printed totals; YES where any of the three is more
    than a cent apart; the printed ones are taken if both sides are there."""
    names = ("withdrawal", "deposit", "closing_balance")
    p = printed.select(*keys, *[F.col(n).alias(f"printed_{n}") for n in names])
    joined = calculated.join(p, list(keys), "left")
    apart = F.greatest(*[F.abs(F.coalesce(F.col(n) - F.col(f"printed_{n}"), F.lit(0.0))) for n in names])
    use = F.col("printed_withdrawal").isNotNull() & F.col("printed_deposit").isNotNull()
    return joined.select(
        *keys,
        *names,
        *[f"printed_{n}" for n in names],
        F.when(apart > 0.01, "YES").otherwise("NO").alias("mismatch"),
        F.when(use, "printed").otherwise("calculated").alias("source"),
    )


def with_grand_total(rows: DataFrame, label: str, label_col: str, sums: list[str]) -> DataFrame:
    """The rows and one GRAND TOTAL row, as a workbook has it."""
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).select(
        *[F.lit(label).alias(c) if c == label_col else F.col(c) if c in sums else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    )
    return rows.unionByName(total)
