"""Report modules: name -> plan over the fact table.

``COMPUTED`` modules hold what a report computes; ``EXTENSIONS`` fill report
tables that have a layout but no rule of their own with plain rules, stated
here.  Every plan keys its rows by account_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators.ledger import filed, labelled_rows, party_rows, segment_party, summarize
from ..operators.metrics import daily_flow, dbl, month_metrics, totals_of_months
from ..operators.prefix import counted
from ..operators.scope import scope_month
from ..sources.scratch import written


class Facts:
    """A view of the transactions with what several modules share: month metrics, resolved rows,
    sums by month and category.  With keep, each is written once and read by all modules of a book."""

    def __init__(self, rows: DataFrame, keep: bool = False):
        self.keep = keep
        self.rows = written(rows, "book-facts") if keep else rows

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name) if self.keep else df

    @cached_property
    def months(self) -> DataFrame:
        return self.kept(month_metrics(self.rows), "book-months")

    @cached_property
    def filed(self) -> DataFrame:
        return self.kept(counted(party_rows(self.rows)), "book-parties")

    @cached_property
    def filed_amounts(self) -> DataFrame:
        """Numbered rows with party, date and amounts, for plans that show nothing else of them; written, as
        they are read more than once."""
        if self.keep:
            return self.filed
        rows = party_rows(self.rows.drop("balance", "txn_id", "direction", "amount", "month_key", "month", "mode", "category"))
        return written(counted(rows).select("account_id", "seq", "txn_date", "filed_party", "debit", "credit"), "filed-amounts")

    def party_sums(self, where: Column, side: str) -> DataFrame:
        """(account_id, filed_party, month_key, n, s): rows and sum of a side over the rows that a condition
        on category, debit and credit picks.  Sums are made by label and then filed, so that no row meets the join."""
        if self.keep:
            rows, sums = self.filed.filter(where), lambda df: df
        else:
            rows, shown = labelled_rows(self.rows, ("month_key", "category", "debit", "credit"))
            rows, sums = rows.filter(where), lambda df: filed(df, shown, ("account_id",))
        by = ["account_id", "label", "manual_party", "month_key"] if not self.keep else ["account_id", "filed_party", "month_key"]
        part = sums(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(side).alias("s")))
        return part.groupBy("account_id", "filed_party", "month_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    @cached_property
    def categories(self) -> DataFrame:
        """(account_id, month_key, category): counts and sums of both sides."""
        some = lambda side: F.count_if(F.col(side) > 0).alias(f"n_{side}")
        sums = self.rows.groupBy("account_id", "month_key", "category").agg(some("debit"), some("credit"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
        return self.kept(sums, "book-categories")


def over(txns: DataFrame | Facts) -> Facts:
    return txns if isinstance(txns, Facts) else Facts(txns)


def first_by_date(txns: DataFrame | Facts, category: str, most: int = 100) -> DataFrame:
    """The first rows of a category by date, per account."""
    w = Window.partitionBy("account_id").orderBy("txn_date", "seq")
    rows = over(txns).rows.filter(F.col("category") == category).withColumn("sn", F.row_number().over(w)).filter(F.col("sn") <= most)
    return rows.select("account_id", "sn", F.date_format("txn_date", "yyyy-MM-dd").alias("date_text"), segment_party("narration").alias("party"), dbl(F.col("amount")).alias("amount"), "mode", "narration")


def raw_data(txns: DataFrame | Facts) -> DataFrame:
    none_if_zero = lambda x: F.nullif(dbl(F.col(x)), F.lit(0.0)).alias(x)
    return over(txns).rows.select(
        "account_id", F.col("seq").alias("sn"), F.date_format("txn_date", "yyyy-MM-dd").alias("date_text"), "narration", none_if_zero("debit"), none_if_zero("credit"), dbl(F.col("balance")).alias("balance")
    )


def mom_summary(txns: DataFrame | Facts) -> DataFrame:
    return over(txns).months


def executive_summary(txns: DataFrame | Facts) -> DataFrame:
    return totals_of_months(over(txns).months)


def monthly_cashflow(txns: DataFrame | Facts) -> DataFrame:
    return over(txns).months.select("account_id", "month_key", "opening_balance", F.col("total_credits").alias("inflow"), F.col("total_debits").alias("outflow"), "net", "closing_balance")


def net_transactions(txns: DataFrame | Facts) -> DataFrame:
    return over(txns).months.select("account_id", "month_key", "total_credits", "total_debits", "net", (F.col("credit_count") + F.col("debit_count")).alias("txn_count"))


def ledger_book(txns: DataFrame | Facts) -> DataFrame:
    """The bank's own book: money in stands under debit, money out under credit;
    a row with both is money out.  Rows stand under the party of the ledger."""
    out = F.col("debit") > 0
    zero = F.lit(0.0)
    said = F.col("fine_mode"), F.col("party_category"), F.col("narration")
    return over(txns).filed.withColumn("_ledger_text", c.upper_text(*said)).select(
        "account_id",
        F.col("seq").alias("voucher_no"),
        F.date_format("txn_date", "yyyy-MM-dd").alias("date_text"),
        F.when(out, "Cr").otherwise("Dr").alias("side"),
        F.col("filed_party").alias("party"),
        F.col("label").alias("original_party"),
        c.counter_ledger(*said, F.col("_ledger_text")).alias("counter_ledger"),
        F.when(out, zero).otherwise(dbl(F.col("credit"))).alias("debit"),
        F.when(out, dbl(F.col("debit"))).otherwise(zero).alias("credit"),
    )


def transactions_summary(txns: DataFrame | Facts) -> DataFrame:
    return summarize(over(txns).filed).drop("first_seen")


def transactions_detail(txns: DataFrame | Facts) -> DataFrame:
    """Detail rows under their party, level 1 below the summary's level 0."""
    filed = over(txns).filed
    w = Window.partitionBy("account_id", "filed_party").orderBy("txn_date", "seq")
    return filed.select(
        "account_id", F.col("filed_party").alias("party"), F.lit(1).alias("outline_level"), F.row_number().over(w).alias("row_no"),
        F.date_format("txn_date", "yyyy-MM-dd").alias("date_text"), "fine_mode", "narration", dbl(F.col("debit")).alias("debit"), dbl(F.col("credit")).alias("credit"),
    )


def party_outline(txns: DataFrame | Facts) -> DataFrame:
    """Summary and detail as one outline: level 0 is a party, level 1 its rows by date."""
    detail = transactions_detail(txns)
    total = lambda x: dbl(F.sum(F.col(x).cast("decimal(18,2)"))).alias(x)
    none = lambda kind: F.lit(None).cast(kind)
    head = detail.groupBy("account_id", "party").agg(total("debit"), total("credit"))
    return head.select(
        "account_id", "party", F.lit(0).alias("outline_level"), F.lit(0).alias("row_no"), none("string").alias("date_text"), none("string").alias("fine_mode"), none("string").alias("narration"), "debit", "credit"
    ).unionByName(detail)


def trade_rows(txns: DataFrame | Facts) -> DataFrame:
    """Facts out of the two trade lists, for reports that hold no transactions."""
    side = lambda name, way: COMPUTED[name](txns).select(
        "account_id", "date_text", "party", "narration", F.lit(way).alias("direction"),
        F.when(F.lit(way) == "Debit", F.col("amount")).otherwise(0.0).alias("debit"), F.when(F.lit(way) == "Credit", F.col("amount")).otherwise(0.0).alias("credit"),
    )
    return side("trade-credits", "Credit").unionByName(side("trade-debits", "Debit"))


def book_rows(txns: DataFrame | Facts, names: list[str] | None = None) -> DataFrame:
    """All modules as one table: module, account_id, and the other columns of a row as JSON."""
    facts = txns if isinstance(txns, Facts) else Facts(txns, keep=True)
    out = None
    for name in names or sorted(COMPUTED | EXTENSIONS):
        df = (COMPUTED | EXTENSIONS)[name](facts)
        row = df.select(F.lit(name).alias("module"), "account_id", F.to_json(F.struct(*[x for x in df.columns if x != "account_id"])).alias("row"))
        out = row if out is None else out.unionByName(row)
    return out


def master_book(txns: DataFrame | Facts, path: str, names: list[str] | None = None) -> list[str]:
    """Every module under one folder, a partition each, by one write over facts that are resolved once."""
    book_rows(txns, names).write.mode("overwrite").partitionBy("module").parquet(path)
    return names or sorted(COMPUTED | EXTENSIONS)


def read_module(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A module of a written book, with its columns."""
    rows = spark.read.parquet(path).filter(F.col("module") == name)
    return rows.select("account_id", F.from_json("row", schema).alias("r")).select("account_id", "r.*")


def highest_transactions(txns: DataFrame | Facts, most: int = 10) -> DataFrame:
    w = Window.partitionBy("account_id", "direction").orderBy(F.desc("amount"), "seq")
    return over(txns).rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("account_id", "direction", "rank", "seq", dbl(F.col("amount")).alias("amount"))


def spend_analysis(txns: DataFrame | Facts) -> DataFrame:
    per = over(txns).categories.filter("n_debit > 0").groupBy("account_id", "category").agg(F.sum("debit").alias("total"), F.sum("n_debit").alias("txn_count"))
    whole = F.sum("total").over(Window.partitionBy("account_id"))
    return per.select("account_id", "category", dbl(F.col("total")).alias("total"), "txn_count", c.round2(dbl(F.col("total")) * 100 / dbl(whole)).alias("share"))


def recurring(txns: DataFrame | Facts, side: str, months: int = 3) -> DataFrame:
    per = over(txns).party_sums(F.col(side) > 0, side).withColumnRenamed("filed_party", "party")
    return (
        per.groupBy("account_id", "party")
        .agg(F.count(F.lit(1)).alias("n_months"), F.sum("n").alias("txn_count"), dbl(F.sum("s")).alias("total"))
        .filter(F.col("n_months") >= months)
    )


def of_category(txns: DataFrame | Facts, category: str, side: str) -> DataFrame:
    n = F.col(f"n_{side}")
    rows = over(txns).categories.filter((F.col("category") == category) & (n > 0))
    return rows.select("account_id", "month_key", n.alias("txn_count"), dbl(F.col(side)).alias("total"), c.round2(dbl(F.col(side)) / n).alias("mean_amount"))


def bounce_penal(txns: DataFrame | Facts) -> DataFrame:
    rows = over(txns).rows.filter(F.upper("narration").rlike(r"BOUNCE|RETURN|PENAL|INSUFFICIENT|CHARGE"))
    kind = F.when(F.upper("narration").rlike("BOUNCE|RETURN|INSUFFICIENT"), "bounce").otherwise("penal")
    return rows.groupBy("account_id", "month_key", kind.alias("kind")).agg(F.count(F.lit(1)).alias("txn_count"), dbl(F.sum("debit")).alias("total"))


def internal_group(txns: DataFrame | Facts) -> DataFrame:
    own = over(txns).filed.filter((F.col("txn_party_type") == "self") | F.upper("narration").rlike(r"\bSELF\b"))
    return own.groupBy("account_id", "month_key").agg(F.count(F.lit(1)).alias("txn_count"), dbl(F.sum("debit")).alias("debit"), dbl(F.sum("credit")).alias("credit"))


def circular_flows(txns: DataFrame | Facts, days: int = 7) -> DataFrame:
    """Money in that goes out again to the same party within some days: every pair of a row of money in
    and a row of money out.

    An equi-join by buckets of that many days and one: money in meets its own bucket and the next, so a
    party of any size is cut by time; a pair is found in one bucket only.  There are as many rows as pairs,
    which grow with the square of a party's rows a day."""
    rows = over(txns).filed_amounts.filter("filed_party != 'UNRECOGNIZED'").withColumn("_day", F.unix_date("txn_date"))
    bucket = F.floor(F.col("_day") / (days + 1))
    pick = lambda way, amount, buckets: rows.filter(F.col(amount) > 0).select(
        "account_id", F.col("filed_party").alias("party"), F.explode(buckets).alias("_b"), F.col("_day").alias(f"_{way}_day"), F.col("seq").alias(f"{way}_seq"), dbl(F.col(amount)).alias(f"{way}_amount")
    )
    both = pick("in", "credit", F.array(bucket, bucket + 1)).join(pick("out", "debit", F.array(bucket)), ["account_id", "party", "_b"])
    apart = F.col("_out_day") - F.col("_in_day")
    return both.filter(apart.between(0, days)).select(
        "account_id", "party", "in_seq", "out_seq", apart.cast("long").alias("days"), "in_amount", "out_amount"
    )


def flags(txns: DataFrame | Facts) -> DataFrame:
    """Months with a negative net flow, a negative closing balance or much cash."""
    m = over(txns).months
    flag = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(F.array(flag(F.col("net") < 0, "negative_net"), flag(F.col("closing_balance") < 0, "negative_closing"), flag(F.col("cash_deposit") * 2 > F.col("total_credits"), "cash_heavy")))
    return m.select("account_id", "month_key", F.explode(found).alias("flag"))


def cam_analysis(txns: DataFrame | Facts) -> DataFrame:
    returns = over(txns).rows.groupBy("account_id", "month_key").agg(F.count_if(F.upper("narration").rlike("BOUNCE|RETURN")).alias("return_count"))
    return over(txns).months.join(returns, ["account_id", "month_key"]).select("account_id", "month_key", "total_credits", "total_debits", "credit_count", "debit_count", "mean_balance", "return_count")


def emi_tracker(txns: DataFrame | Facts) -> DataFrame:
    per = over(txns).party_sums((F.col("category") == "Loan & EMI") & (F.col("debit") > 0), "debit")
    return per.select("account_id", F.col("filed_party").alias("lender"), "month_key", F.col("n").alias("txn_count"), dbl(F.col("s")).alias("total"))


COMPUTED: dict[str, Callable[[DataFrame | Facts], DataFrame]] = {
    "raw-data": raw_data,
    "executive-summary": executive_summary,
    "mom-summary": mom_summary,
    "monthly-cf": monthly_cashflow,
    "trade-credits": lambda t: first_by_date(t, "Trade Credit"),
    "trade-debits": lambda t: first_by_date(t, "Trade Debit"),
    "transactions-summary": transactions_summary,
    "transactions-detail": transactions_detail,
    "transactions-ledger": ledger_book,
}
EXTENSIONS: dict[str, Callable[[DataFrame | Facts], DataFrame]] = {
    "flags": flags,
    "cam-analysis": cam_analysis,
    "bounce-penal": bounce_penal,
    "loans-emi": lambda t: of_category(t, "Loan & EMI", "debit"),
    "emi-tracker": emi_tracker,
    "highest-transactions": highest_transactions,
    "internal-group": internal_group,
    "circular-flows": circular_flows,
    "net-transactions": net_transactions,
    "salary": lambda t: of_category(t, "Salary", "credit"),
    "staff-emoluments": lambda t: of_category(t, "Salary", "debit"),
    "spend-analysis": spend_analysis,
    "bill-payments": lambda t: of_category(t, "Utilities", "debit"),
    "recurring-debits": lambda t: recurring(t, "debit"),
    "recurring-credits": lambda t: recurring(t, "credit"),
}
ALIASES = {
    "cashflow": "monthly-cf",
    "flags-risk": "flags",
    "transactions-summary-ca": "transactions-summary",
    "party-analysis-ca": "transactions-summary",
    "ledger-book": "transactions-ledger",
    "manual-ledger": "transactions-ledger",
}


def generic_sheet(spark: SparkSession, name: str) -> DataFrame:
    """What a module without a plan of its own shows."""
    title = " ".join(w[:1].upper() + w[1:] for w in name.split("-"))
    return spark.createDataFrame([(title, "Module data will be available soon")], "sheet string, message string")


def module(name: str, txns: DataFrame, month_key: str | None = None) -> DataFrame:
    """A report module over a view of the transactions; unknown names give a generic sheet."""
    name = ALIASES.get(name, name)
    plans = COMPUTED | EXTENSIONS
    if name not in plans:
        return generic_sheet(txns.sparkSession, name)
    return plans[name](scope_month(txns, month_key))


__all__ = ["ALIASES", "COMPUTED", "EXTENSIONS", "daily_flow", "generic_sheet", "module"]
