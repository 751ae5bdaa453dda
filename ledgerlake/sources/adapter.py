"""The driver's star-schema tables as bank transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators.prefix import running

ORDER = ["txn_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, txn_date, narration, debit, credit and the order columns."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("p"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    kind = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10
    ref = (F.col("l_orderkey") + 100000).cast("string")
    p = F.col("p")
    shapes = [
        F.concat(F.lit("UPI-"), p, F.lit("-"), ref, F.lit("@ybl")),
        F.concat(F.lit("NEFT DR-HDFC0001234-"), p),
        F.concat(F.lit("IMPS/P2A/"), ref, F.lit("/"), p),
        F.lit("CASH DEPOSIT SELF"),
        F.concat(F.lit("ACH D- "), p, F.lit(" EMI")),
        F.concat(F.lit("CHQ PAID-"), p, F.lit(" TRADERS")),
        F.concat(F.lit("SALARY "), p),
        F.lit("GST PAYMENT"),
        F.lit("SMS_CHARGE_FOR_JAN25"),
        F.concat(F.when(F.col("l_orderkey") % 3 == 0, "ELECTRICITY BILL ").otherwise("RENT "), p),
    ]
    narration = F.coalesce(*[F.when(kind == i, s) for i, s in enumerate(shapes)])
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    odd = F.col("l_linenumber") % 2 == 1
    return joined.select(
        (F.col("o_custkey") % 50).alias("account_id"),
        F.col("l_shipdate").cast("date").alias("txn_date"),
        narration.alias("narration"),
        F.when(odd, zero).otherwise(amount).alias("debit"),
        F.when(odd, amount).otherwise(zero).alias("credit"),
        *[x for x in ORDER if x != "txn_date"],
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: raw transactions with seq, balance and derived columns."""
    raw = raw_transactions(spark, sf_dir)
    signed = (F.col("credit") - F.col("debit")).cast("decimal(18,2)")
    full = running(raw, ["account_id"], F.trunc("txn_date", "month"), ORDER, "seq", {"balance": signed})
    txn_id = F.concat_ws("-", (F.col("account_id") + 1).cast("string"), F.col("seq").cast("string")).alias("txn_id")
    return derived(full, "balance", txn_id)


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table without what runs over an account (balance, txn_id): seq is a struct that orders
    the rows of a day, which operators.prefix.counted turns into the number where a plan shows it."""
    raw = raw_transactions(spark, sf_dir)
    return derived(raw.withColumn("seq", F.struct(*ORDER[1:])))


def derived(rows: DataFrame, *more: Column | str) -> DataFrame:
    way = c.direction(F.col("debit"), F.col("credit"))
    text = {"narration": F.col("narration"), "upper": F.col("_upper")}
    return rows.withColumn("_upper", F.coalesce(F.upper("narration"), F.lit(""))).select(
        "account_id",
        "seq",
        "txn_date",
        "narration",
        "debit",
        "credit",
        *more,
        way.alias("direction"),
        F.greatest("debit", "credit").alias("amount"),
        c.month_key(F.col("txn_date")).alias("month_key"),
        c.month_label(F.col("txn_date")).alias("month"),
        c.mode(**text).alias("mode"),
        c.category(**text, way=way).alias("category"),
    )
