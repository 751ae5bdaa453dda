"""Period scope of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import key_of_label
from .prefix import running

ROWS_AT_ONCE = 1 << 16


def scope_month(txns: DataFrame, key: str | None) -> DataFrame:
    """Transactions of a month, by key or label; an unknown month changes nothing.

    The test for the month is one aggregated row, joined by broadcast: no action
    runs while the plan is built."""
    if not key:
        return txns
    mine = (F.col("month_key") == key) | (F.col("month") == key)
    known = txns.agg(F.coalesce(F.max(mine), F.lit(False)).alias("_known"))
    return txns.crossJoin(F.broadcast(known)).filter(mine | ~F.col("_known")).drop("_known")


def scope_rows(rows: DataFrame, key: str, columns: tuple[str, ...] = ("month_key", "month", "date_text")) -> DataFrame:
    """Rows of report tables that carry a month in one of several ways."""
    have = [c for c in columns if c in rows.columns]
    test = F.lit(False)
    for c in have:
        test = test | (F.col(c) == key) | F.col(c).startswith(key)
    return rows.filter(test)


def month_options(txns: DataFrame) -> DataFrame:
    return txns.select("month_key", "month").distinct()


def same_month(rows: DataFrame, month: str, column: str = "month") -> DataFrame:
    """Rows of a month, whichever way either side writes it."""
    return rows.filter(key_of_label(F.col(column)) == key_of_label(F.lit(month)))


def rows_of_month(rows: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Rows that carry a month in any way: the key, its label, or a date; each alone is enough.

    A row without a key takes that of its label (two-digit years from 50 on are the past century)."""
    have = set(rows.columns)
    column = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    own = F.coalesce(F.nullif(column("month_key"), F.lit("")), key_of_label(column("month")))
    date = column("date_text")
    named = r"(\d{1,2})[/-]([A-Za-z]{3})[/-](\d{2,4})"
    part = lambda i: F.regexp_extract(date, named, i)
    dated = F.when(date.rlike(r"^\d{4}-\d{2}"), F.left(date, F.lit(7))).when(date.rlike(named), key_of_label(F.concat_ws("-", part(2), part(3))))
    hit = F.coalesce(own == key, F.lit(False)) | F.coalesce(dated == key, F.lit(False))
    return rows.filter(hit | F.coalesce(column("month") == F.lit(label), F.lit(False)))


def cleaned_rows(rows: DataFrame, order: tuple[str, ...] = (), keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Party and narration as a screen shows them.  With an order, rows without an ``id`` get one by their
    number in the list: txn-0 is the first."""
    named = lambda x, other: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(other)).alias(x)
    shown = {"party": named("party", "UNRECOGNIZED"), "narration": named("narration", "Transaction")}
    out = rows.select(*[shown.get(x, F.col(x)) for x in rows.columns])
    if not order:
        return out
    listed = running(out, list(keys), F.floor(F.col(order[0]) / ROWS_AT_ONCE), list(order), "_no", {})
    made = F.concat(F.lit("txn-"), (F.col("_no") - 1).cast("string"))
    given = F.nullif(F.col("id"), F.lit("")) if "id" in rows.columns else F.lit(None)
    return listed.withColumn("id", F.coalesce(given, made)).drop("_no")


def excluded_only(hydrated: DataFrame) -> DataFrame:
    return hydrated.filter(F.coalesce("excluded", F.lit(False)))


def analysis(rows: DataFrame, analysis_id: str, column: str = "analysis_id") -> DataFrame:
    """One analysis of a table that holds many."""
    return rows.filter(F.col(column) == analysis_id)
