"""Statements to transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c

STATEMENTS = (
    "analysis_id string, applicantName string, statements array<struct<fileName:string,"
    "accountInfo:array<struct<label:string,value:string>>,"
    "transactions:array<struct<date:string,particulars:string,narration:string,withdrawal:double,deposit:double,balance:double>>>>"
)
#: fixed values: bank display names by what their names and codes contain
BANKS = [
    ("STATE BANK", "State Bank of India"),
    ("HDFC", "HDFC Bank"),
    ("ICICI", "ICICI Bank"),
    ("AXIS", "Axis Bank"),
    ("KOTAK", "Kotak Mahindra Bank"),
    ("BARODA", "Bank of Baroda"),
    ("YES BANK", "Yes Bank"),
]


def info(entries: Column, pattern: str) -> Column:
    """The value of the first label that matches."""
    return F.get(F.filter(entries, lambda e: e["label"].rlike(pattern)), F.lit(0))["value"]


def bank_name(entries: Column, file_name: Column) -> Column:
    """From the bank label, the IFSC code, or the file's name."""
    said = info(entries, r"(?i)bank")
    code = F.upper(F.left(F.trim(info(entries, r"(?i)ifsc")), F.lit(4)))
    by_code = F.coalesce(c.bank_of_code(code), F.lit(None).cast("string"))
    text = F.upper(F.coalesce(F.nullif(F.trim(said), F.lit("")), by_code, F.regexp_replace(file_name, "[_-]", " ")))
    shown = F.coalesce(*[F.when(text.contains(k), v) for k, v in BANKS], F.initcap(F.coalesce(said, by_code)))
    return F.coalesce(shown, F.lit("Bank"))


def account_suffix(entries: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(info(entries, r"(?i)account\s*(no|number)"), F.lit("")), r"\D", "")
    return F.nullif(F.right(digits, F.lit(4)), F.lit(""))


def holder_name(entries: Column, file_name: Column, applicant: Column) -> Column:
    """From the statement, else a titled file name, else the applicant."""
    said = F.nullif(F.trim(info(entries, r"(?i)(account\s*name|holder|customer\s*name)")), F.lit(""))
    titled = F.nullif(F.trim(F.regexp_extract(F.regexp_replace(file_name, "[_-]", " "), r"(?i)\b((?:mr|mrs|ms|m/s)\.? [a-z .]+?)(?: \d|\.pdf|$)", 1)), F.lit(""))
    return F.coalesce(said, titled, F.nullif(F.trim(applicant), F.lit("")), F.lit("Applicant"))


def normalize(statements: DataFrame) -> DataFrame:
    """The fact table from statement documents (schema STATEMENTS).

    Positions count before rows are dropped, so identifiers keep gaps; rows
    without a date or with both sides 0 are dropped.  What a statement says is read once, and only
    that goes with its rows: a row that carried the statement would make it square in its length."""
    each = statements.select("analysis_id", "applicantName", F.posexplode("statements").alias("stmt_idx", "s"))
    entries, file_name = F.col("s.accountInfo"), F.col("s.fileName")
    stated = each.select(
        "analysis_id", "stmt_idx", bank_name(entries, file_name).alias("bank_name"), account_suffix(entries).alias("account_suffix"),
        holder_name(entries, file_name, F.col("applicantName")).alias("holder"), F.col("s.transactions").alias("transactions"),
    )
    flat = stated.select("analysis_id", "stmt_idx", "bank_name", "account_suffix", "holder", F.posexplode("transactions").alias("txn_idx", "t"))
    day = c.parsed_date(F.col("t.date"))
    debit, credit = (c.money(F.col(f"t.{x}")).cast("decimal(18,2)") for x in ("withdrawal", "deposit"))
    way = c.direction(F.col("debit"), F.col("credit"))
    text = lambda x: F.nullif(F.trim(F.col(x)), F.lit(""))
    return (
        flat.select(
            "analysis_id",
            "stmt_idx",
            "txn_idx",
            F.concat_ws("-", (F.col("stmt_idx") + 1).cast("string"), (F.col("txn_idx") + 1).cast("string")).alias("txn_id"),
            day.alias("txn_date"),
            c.clean_narration(F.coalesce(text("t.particulars"), text("t.narration"), F.lit("TRANSACTION"))).alias("narration"),
            debit.alias("debit"),
            credit.alias("credit"),
            F.when(~F.isnan("t.balance") & (F.abs("t.balance") < float("inf")), F.col("t.balance")).cast("decimal(18,2)").alias("balance"),
            "bank_name",
            "account_suffix",
            "holder",
        )
        .filter("txn_date IS NOT NULL AND (debit > 0 OR credit > 0)")
        .select(
            "*",
            way.alias("direction"),
            F.when(way == "Credit", F.col("credit")).otherwise(F.col("debit")).alias("amount"),
            F.date_format("txn_date", "yyyy-MM-dd").alias("date_text"),
            c.month_key(F.col("txn_date")).alias("month_key"),
            c.month_label(F.col("txn_date")).alias("month"),
            c.mode(F.col("narration")).alias("mode"),
            c.category(F.col("narration"), way).alias("category"),
            (F.unix_date("txn_date").cast("long") * F.lit(1 << 40) + F.col("stmt_idx").cast("long") * F.lit(1 << 24) + F.col("txn_idx")).alias("seq"),
        )
    )


def applicant_banks(statements: DataFrame) -> DataFrame:
    """(analysis_id, stmt_idx, bank, account, ifsc, branch) of every statement."""
    each = statements.select("analysis_id", F.posexplode("statements").alias("stmt_idx", "s"))
    flat = each.select("analysis_id", "stmt_idx", F.col("s.fileName").alias("f"), F.col("s.accountInfo").alias("e"))
    text = lambda x: F.nullif(x, F.lit(""))
    return flat.select(
        "analysis_id",
        "stmt_idx",
        bank_name(F.col("e"), F.col("f")).alias("bank"),
        F.coalesce(text(info(F.col("e"), r"(?i)account number")), text(F.col("f")), F.concat(F.lit("Account "), (F.col("stmt_idx") + 1).cast("string"))).alias("account"),
        F.coalesce(text(info(F.col("e"), r"(?i)ifsc")), F.lit("-")).alias("ifsc"),
        F.coalesce(text(info(F.col("e"), r"(?i)branch")), F.lit("-")).alias("branch"),
    )
