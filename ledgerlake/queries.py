"""Registered queries over the driver's tables and the same in DuckDB SQL.

The SQL is written on its own from the same rules, not derived from the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as c
from .operators import balances, ledger, metrics, normalize, overrides, parsing, scope
from .operators.metrics import dbl
from .plans import modules
from .sources.adapter import raw_transactions, table, transactions, unnumbered
from .sources.scratch import written
from .sources.sinks import export_name
from .streaming.daily import daily_totals

Query = Callable[[SparkSession, str], DataFrame]
MONTH = "1996-03"

# --- SQL building blocks -----------------------------------------------------

MODE = """CASE WHEN regexp_matches(upper({0}), '\\bUPI\\b') THEN 'UPI' WHEN regexp_matches(upper({0}), '\\bRTGS\\b') THEN 'RTGS'
 WHEN regexp_matches(upper({0}), '\\bNEFT\\b') THEN 'NEFT' WHEN regexp_matches(upper({0}), '\\bIMPS\\b') THEN 'IMPS'
 WHEN regexp_matches(upper({0}), '\\b(ECS|NACH|ACH)\\b') THEN 'ECS/NACH' WHEN regexp_matches(upper({0}), '\\bATM\\b') THEN 'ATM'
 WHEN regexp_matches(upper({0}), '\\bCASH\\b') THEN 'CASH' WHEN regexp_matches(upper({0}), '\\b(CHQ|CHEQUE|CLG)\\b') THEN 'CHEQUE' ELSE 'OTHER' END"""
CATEGORY = """CASE WHEN regexp_matches(upper({0}), '\\b(SALARY|PAYROLL|WAGES)\\b') THEN 'Salary'
 WHEN regexp_matches(upper({0}), '\\b(EMI|LOAN|FINANCE|NACH|ECS)\\b') THEN 'Loan & EMI'
 WHEN regexp_matches(upper({0}), '\\b(GST|TDS|TAX|PF|ESIC)\\b') THEN 'Statutory'
 WHEN regexp_matches(upper({0}), '\\bELECTRIC|POWER|MSEB|UTILITY|GAS|WATER|BILL\\b|AIRTEL|JIO|VODAFONE') THEN 'Utilities'
 WHEN regexp_matches(upper({0}), '\\b(RENT|LEASE)\\b') THEN 'Rent'
 WHEN regexp_matches(upper({0}), '\\bCASH\\b') THEN CASE WHEN {1} = 'Credit' THEN 'Cash Deposit' ELSE 'Cash Withdrawal' END
 WHEN regexp_matches(upper({0}), '\\b(CHARGE|PENAL|BOUNCE|RETURN|INSUFFICIENT)\\b') THEN 'Bank Charges'
 WHEN regexp_matches(upper({0}), '\\b(UPI|POS|CARD)\\b') THEN 'Digital Payments'
 WHEN {1} = 'Credit' THEN 'Trade Credit' ELSE 'Trade Debit' END"""
FINE_MODE = """CASE WHEN regexp_matches({0}, '\\bUPI\\b') THEN 'UPI' WHEN regexp_matches({0}, '\\bIMPS\\b') THEN 'IMPS' WHEN regexp_matches({0}, '\\bNEFT\\b') THEN 'NEFT'
 WHEN regexp_matches({0}, '\\bRTGS\\b') THEN 'RTGS' WHEN regexp_matches({0}, '\\b(CHQ|CHEQUE|CLG)\\b') THEN 'CHEQUE' WHEN regexp_matches({0}, '\\b(CARD|POS)\\b') THEN 'CARD'
 WHEN regexp_matches({0}, '\\b(ACH|NACH|ECS)\\b') THEN 'ACH' WHEN regexp_matches({0}, '\\bAUTOPAY\\b') THEN 'AUTOPAY' WHEN regexp_matches({0}, '\\bSI\\b') THEN 'SI'
 WHEN regexp_matches({0}, '\\b(CASH|ATM)\\b') THEN 'CASH' WHEN regexp_matches({0}, '\\bSWEEP\\b') THEN 'SWEEP' WHEN regexp_matches({0}, '\\b(INTEREST|INT\\.?)\\b') THEN 'INTEREST'
 WHEN regexp_matches({0}, '\\b(CHARGE|CHARGES|FEE|PENAL)\\b') THEN 'BANK CHARGES' ELSE 'TRANSFER' END"""
EVENT = """CASE WHEN regexp_matches({0}, '\\bSWEEP\\b') THEN 'BANK SWEEP' WHEN regexp_matches({0}, '\\bSETTLEMENT\\b') THEN 'BANK SETTLEMENT'
 WHEN regexp_matches({0}, '\\bCHARGES?\\s+FOR\\b|\\bSMS[_\\s]?CHARGE') THEN 'BANK CHARGES'
 WHEN regexp_matches({0}, '\\b(TO|FROM)\\s+SELF\\b|\\bSELF\\s+TRANSFER\\b') THEN 'SELF / INTERNAL TRANSFER' END"""
PARTY_CATEGORY = """CASE WHEN regexp_matches({0}, '\\b(MSEDCL|MSEB|ELECTRIC|POWER|GAS|WATER|AIRTEL|JIO|VODAFONE|UTILITY)\\b') THEN 'UTILITY'
 WHEN regexp_matches({0}, '\\b(GST|TDS|TAX|CBDT|PF|ESIC)\\b') THEN 'STATUTORY' WHEN regexp_matches({0}, '\\b(BANK CHARGES|CHARGE|FEE|PENAL)\\b') THEN 'BANK CHARGES'
 WHEN regexp_matches({0}, '\\b(BANK INTEREST|INTEREST|INT ON)\\b') THEN 'INTEREST' WHEN regexp_matches({0}, '\\b(EMI|LOAN|NACH|ECS|FINANCE|FINSERV)\\b') THEN 'LOAN/EMI'
 WHEN regexp_matches({0}, '\\b(SALARY|PAYROLL|WAGES)\\b') THEN 'SALARY' WHEN regexp_matches({0}, '\\bCASH\\b') THEN 'CASH' ELSE upper(category) END"""
COUNTER = """CASE WHEN regexp_matches({0}, '\\bCASH\\b') THEN 'Cash' WHEN regexp_matches({0}, '\\b(EMI|LOAN|NACH|ECS|ACH|AUTOPAY|MANDATE)\\b') THEN 'EMI / Loan'
 WHEN regexp_matches({0}, '\\b(CHARGE|CHARGES|GST|FEE|PENAL|BOUNCE)\\b') THEN 'Bank Charges' WHEN regexp_matches({0}, '\\b(INTEREST|INT)\\b') THEN 'Interest'
 WHEN regexp_matches({0}, '\\b(SALARY|WAGES|STAFF)\\b') THEN 'Salary / Staff' ELSE 'Others' END"""
PARTY_TYPE = """CASE WHEN {0} = 'UNRECOGNIZED' THEN 'unrecognized' WHEN {0} = 'SELF / INTERNAL TRANSFER' THEN 'self' WHEN {0} IN ('BANK INTEREST', 'BANK CHARGES', 'CARD AUTOPAY') THEN 'charge'
 WHEN {0} IN ('BANK SWEEP', 'BANK SETTLEMENT', 'UPI SETTLEMENT') THEN 'bank_system' WHEN regexp_matches({0}, '\\b(TRADERS?|STORES?|MART|MOTORS|LTD|SHOP)\\b') THEN 'merchant' ELSE 'person' END"""
TXN = (
    """WITH base AS (SELECT o_custkey % 50 AS account_id, CAST(l_shipdate AS DATE) AS txn_date, upper(p_name) AS p, CAST(l_orderkey + 100000 AS VARCHAR) AS ref,
 (l_orderkey * 7 + l_linenumber) % 10 AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
told AS (SELECT *, CASE k WHEN 0 THEN 'UPI-' || p || '-' || ref || '@ybl' WHEN 1 THEN 'NEFT DR-HDFC0001234-' || p WHEN 2 THEN 'IMPS/P2A/' || ref || '/' || p WHEN 3 THEN 'CASH DEPOSIT SELF'
 WHEN 4 THEN 'ACH D- ' || p || ' EMI' WHEN 5 THEN 'CHQ PAID-' || p || ' TRADERS' WHEN 6 THEN 'SALARY ' || p WHEN 7 THEN 'GST PAYMENT' WHEN 8 THEN 'SMS_CHARGE_FOR_JAN25' ELSE CASE WHEN l_orderkey % 3 = 0 THEN 'ELECTRICITY BILL ' ELSE 'RENT ' END || p END AS narration,
 CASE WHEN l_linenumber % 2 = 1 THEN amt ELSE 0::DECIMAL(18,2) END AS credit, CASE WHEN l_linenumber % 2 = 1 THEN 0::DECIMAL(18,2) ELSE amt END AS debit FROM base),
seqd AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM told),
txn0 AS (SELECT account_id, seq, txn_date, narration, debit, credit, CAST(sum(credit - debit) OVER (PARTITION BY account_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance,
 CAST(account_id + 1 AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS txn_id, CASE WHEN credit >= debit THEN 'Credit' ELSE 'Debit' END AS direction, greatest(debit, credit) AS amount,
 strftime(txn_date, '%Y-%m') AS month_key, strftime(txn_date, '%b-%y') AS month, k AS shape, p AS pname FROM seqd),
txn AS MATERIALIZED (SELECT *, """
    + MODE.format("narration")
    + " AS mode, "
    + CATEGORY.format("narration", "direction")
    + """ AS category FROM txn0)
"""
)
METRICS = (
    TXN
    + """, m0 AS (SELECT account_id, month_key, min(month) AS month, arg_min_null(CAST(balance - credit + debit AS DECIMAL(18,2)), seq) AS ob, arg_max_null(balance, seq) AS cb, sum(credit) AS tc, sum(debit) AS td,
 count(*) FILTER (credit > 0) AS credit_count, count(*) FILTER (debit > 0) AS debit_count, sum(CASE WHEN category = 'Cash Deposit' THEN credit ELSE 0 END) AS cd,
 sum(CASE WHEN category = 'Cash Withdrawal' THEN debit ELSE 0 END) AS cw, sum(CASE WHEN mode = 'UPI' THEN credit ELSE 0 END) AS uc, sum(CASE WHEN mode = 'UPI' THEN debit ELSE 0 END) AS ud,
 CAST(sum(balance) AS DOUBLE) / count(balance) AS mb FROM txn GROUP BY account_id, month_key),
mm AS (SELECT account_id, month_key, month, CAST(ob AS DOUBLE) AS opening_balance, CAST(cb AS DOUBLE) AS closing_balance, CAST(tc AS DOUBLE) AS total_credits, CAST(td AS DOUBLE) AS total_debits,
 CAST(tc - td AS DOUBLE) AS net, credit_count, debit_count, CAST(cd AS DOUBLE) AS cash_deposit, CAST(cw AS DOUBLE) AS cash_withdrawal, CAST(uc AS DOUBLE) AS upi_credit, CAST(ud AS DOUBLE) AS upi_debit,
 floor((mb + 2.220446049250313e-16::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS mean_balance FROM m0)
"""
)
D = lambda x: f"CAST({x} AS DOUBLE)"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a plan over (spark, folder) under a name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def over_txns(name: str, plan: Callable[[DataFrame], DataFrame], sql: str | None = None, keep: str | None = None, facts: Callable[[SparkSession, str], DataFrame] = transactions) -> None:
    """keep: the columns (parted by blanks) that a plan uses in several places; they are written once, so
    that the facts are joined and numbered once and not in every place."""
    kept = lambda spark, d: facts(spark, d) if keep is None else written(facts(spark, d).select(*keep.split()), "facts")
    query(name, sql)(lambda spark, d: plan(kept(spark, d)))


def as_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[dbl(F.col(n)).alias(n) if t.startswith("decimal") else F.date_format(n, "yyyy-MM-dd").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes])


ROW_SQL = f"account_id, seq, strftime(txn_date, '%Y-%m-%d') AS txn_date, narration, {D('debit')} AS debit, {D('credit')} AS credit, {D('balance')} AS balance, txn_id, direction, {D('amount')} AS amount, month_key, month, mode, category"

# --- facts, labels, scope ----------------------------------------------------

over_txns("normalize_txn", as_doubles, TXN + f"SELECT {ROW_SQL} FROM txn")
over_txns("month_metrics", metrics.month_metrics, METRICS + "SELECT * FROM mm")
over_txns("classify_mode", lambda t: t.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("amount")).alias("total")), TXN + f"SELECT mode, count(*) AS n, {D('sum(amount)')} AS total FROM txn GROUP BY mode")
over_txns(
    "classify_category",
    lambda t: t.groupBy("category", "direction").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum("amount")).alias("total")),
    TXN + f"SELECT category, direction, count(*) AS n, {D('sum(amount)')} AS total FROM txn GROUP BY category, direction",
)
over_txns(
    "fine_mode",
    lambda t: t.select("account_id", "seq", c.fine_mode(F.col("mode"), F.col("narration")).alias("fine_mode")),
    TXN + "SELECT account_id, seq, " + FINE_MODE.format("upper(mode || ' ' || narration)") + " AS fine_mode FROM txn",
)
over_txns("scope_month", lambda t: as_doubles(scope.scope_month(t, MONTH)), TXN + f"SELECT {ROW_SQL} FROM txn WHERE month_key = '{MONTH}'")
over_txns("scope_unknown_month", lambda t: scope.scope_month(t, "none").select("account_id", "seq"), TXN + "SELECT account_id, seq FROM txn")
over_txns("month_options", scope.month_options, TXN + "SELECT DISTINCT month_key, month FROM txn")
FIRST = TXN + "SELECT account_id, sn, strftime(txn_date, '%Y-%m-%d') AS date_text, CASE WHEN shape < 3 THEN pname WHEN shape = 5 THEN pname || ' TRADERS' WHEN shape = 8 THEN 'SMS' END AS party, CAST(amount AS DOUBLE) AS amount, mode, narration FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_date, seq) AS sn FROM txn WHERE category = '{}') WHERE sn <= 100"
over_txns("trade_credits_top100", modules.COMPUTED["trade-credits"], FIRST.format("Trade Credit"))
over_txns("trade_debits_top100", modules.COMPUTED["trade-debits"], FIRST.format("Trade Debit"))
over_txns(
    "daily_flow",
    lambda t: metrics.daily_flow(t, MONTH),
    TXN + f"SELECT account_id, strftime(txn_date, '%Y-%m-%d') AS day, {D('sum(credit)')} AS credits, {D('sum(debit)')} AS debits, {D('sum(credit) - sum(debit)')} AS net, count(*) AS txn_count FROM txn WHERE month_key = '{MONTH}' GROUP BY ALL",
)
over_txns(
    "exec_totals",
    modules.executive_summary,
    METRICS
    + "SELECT account_id, arg_min(opening_balance, month_key) AS opening_balance, arg_max(closing_balance, month_key) AS closing_balance, CAST(sum(CAST(total_credits AS DECIMAL(18,2))) AS DOUBLE) AS total_credits, "
    "CAST(sum(CAST(total_debits AS DECIMAL(18,2))) AS DOUBLE) AS total_debits, CAST(sum(credit_count) AS BIGINT) AS credit_count, CAST(sum(debit_count) AS BIGINT) AS debit_count, count(*) FILTER (net < 0) AS negative_months, count(*) AS n_months FROM mm GROUP BY account_id",
)
TOTALS = TXN + f", st AS (SELECT account_id, {D('sum(debit)')} AS withdrawal, {D('sum(credit)')} AS deposit, {D('arg_max(balance, seq)')} AS closing_balance FROM txn GROUP BY account_id)\n"
over_txns("statement_totals", metrics.statement_totals, TOTALS + "SELECT * FROM st")
over_txns(
    "statement_period",
    metrics.statement_period,
    TXN + "SELECT account_id, strftime(min(txn_date), '%Y-%m-%d') AS period_from, strftime(max(txn_date), '%Y-%m-%d') AS period_to FROM txn GROUP BY account_id",
)


def _printed(t: DataFrame) -> DataFrame:
    """Printed totals for the check: every third account a unit off, every fifth without sides."""
    s = metrics.statement_totals(t)
    off, gone = F.when(F.col("account_id") % 3 == 0, 1.0).otherwise(0.0), F.col("account_id") % 5 == 0
    return s.select("account_id", F.when(~gone, F.col("withdrawal") + off).alias("withdrawal"), F.when(~gone, F.col("deposit")).alias("deposit"), "closing_balance")


over_txns(
    "reconcile_totals",
    lambda t: metrics.reconciled(metrics.statement_totals(t), _printed(t)).select("account_id", "mismatch", "source"),
    TOTALS + "SELECT account_id, CASE WHEN account_id % 3 = 0 AND account_id % 5 <> 0 THEN 'YES' ELSE 'NO' END AS mismatch, CASE WHEN account_id % 5 = 0 THEN 'calculated' ELSE 'printed' END AS source FROM st",
)
over_txns(
    "grand_total",
    lambda t: metrics.with_grand_total(
        t.groupBy("category").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit")).select("category", "debit", "credit"), "GRAND TOTAL", "category", ["debit", "credit"]
    ).select("category", dbl(F.col("debit")).alias("debit"), dbl(F.col("credit")).alias("credit")),
    TXN + f"SELECT coalesce(category, 'GRAND TOTAL') AS category, {D('sum(debit)')} AS debit, {D('sum(credit)')} AS credit FROM txn GROUP BY ROLLUP (category)",
)

# --- balances ----------------------------------------------------------------

LAGS = TXN + ", l AS (SELECT *, lag(balance) OVER w AS prev, lead(balance) OVER w AS nxt FROM txn WINDOW w AS (PARTITION BY account_id ORDER BY seq))\n"
over_txns(
    "infer_side_prev_balance",
    lambda t: balances.infer_side(t).select("account_id", "seq", "side"),
    LAGS + "SELECT account_id, seq, CASE WHEN abs(balance - prev - amount) <= 0.02 THEN 'deposit' WHEN abs(balance - prev + amount) <= 0.02 THEN 'withdrawal' WHEN regexp_matches(upper(narration), '\\b(CR|CREDIT|DEPOSIT)\\b') THEN 'deposit' WHEN regexp_matches(upper(narration), '\\b(DR|DEBIT|WITHDRAWAL|CBDT)\\b') THEN 'withdrawal' ELSE 'deposit' END AS side FROM l",
)
over_txns(
    "delta_next_balance",
    lambda t: balances.side_of_next(t).select("account_id", "seq", dbl(F.col("withdrawal")).alias("withdrawal"), dbl(F.col("deposit")).alias("deposit")),
    LAGS + f"SELECT account_id, seq, {D('CASE WHEN nxt IS NULL THEN debit WHEN abs(balance - nxt) < 0.02 THEN NULL WHEN balance < nxt THEN nxt - balance END')} AS withdrawal, {D('CASE WHEN nxt IS NULL THEN credit WHEN abs(balance - nxt) < 0.02 THEN NULL WHEN balance > nxt THEN balance - nxt END')} AS deposit FROM l",
)
over_txns(
    "reconcile_running",
    lambda t: balances.reconcile_running(t, F.lit(0)).select("account_id", "seq", "status"),
    LAGS + "SELECT account_id, seq, CASE WHEN abs(balance - coalesce(prev, 0) - amount) <= 0.05 THEN 'deposit' WHEN abs(balance - coalesce(prev, 0) + amount) <= 0.05 THEN 'withdrawal' ELSE 'skipped' END AS status FROM l",
)
over_txns(
    "balance_chain_audit",
    balances.chain_mismatches,
    LAGS + "SELECT account_id, count(*) AS n_rows, count(*) FILTER (nxt IS NOT NULL AND abs(balance - nxt - (credit - debit)) > 0.02) AS n_mismatches FROM l GROUP BY account_id",
)
over_txns(
    "balance_synthesis",
    lambda t: as_doubles(balances.from_balances(t)),
    LAGS + ", s AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS k, balance - prev AS ch FROM l WHERE abs(balance - prev) >= 0.01), "
    "dt AS (SELECT account_id, txn_date, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS k FROM txn)\n"
    f"SELECT s.account_id, s.seq, strftime(dt.txn_date, '%Y-%m-%d') AS txn_date, {D('greatest(-ch, 0)')} AS withdrawal, {D('greatest(ch, 0)')} AS deposit FROM s JOIN dt ON s.account_id = dt.account_id AND s.k = dt.k",
    keep="account_id seq txn_date balance",
)

# --- parties -----------------------------------------------------------------

over_txns("party_events", lambda t: t.select("account_id", "seq", c.bank_event(F.col("narration"))["label"].alias("event")), TXN + "SELECT account_id, seq, " + EVENT.format("upper(replace(narration, '_', ' '))") + " AS event FROM txn")
#: What the ladder makes of the shapes of the adapter, and the clusters: a plain name joins the same name with TRADERS.
LABEL = """CASE WHEN shape IN (0, 1, 2) THEN pname WHEN shape = 3 THEN 'DEPOSIT SELF' WHEN shape = 4 THEN 'EMI' WHEN shape = 5 THEN pname || ' TRADERS' WHEN shape = 6 THEN 'SALARY ' || pname WHEN shape = 7 THEN 'GST'
 WHEN shape = 8 THEN 'BANK CHARGES' ELSE split_part(narration, ' ' || pname, 1) || ' ' || pname END"""
PARTY = (
    TXN
    + f", lb AS (SELECT *, {LABEL} AS label, CASE shape WHEN 0 THEN 90 WHEN 4 THEN 80 ELSE 85 END AS confidence, {FINE_MODE.format("upper(mode || ' ' || narration)")} AS fine_mode FROM txn), "
    "tr AS (SELECT DISTINCT account_id, pname AS tp FROM lb WHERE shape = 5), "
    "pt AS MATERIALIZED (SELECT lb.*, CASE WHEN shape < 3 AND tp IS NOT NULL THEN label || ' TRADERS' ELSE label END AS party FROM lb LEFT JOIN tr ON lb.account_id = tr.account_id AND pname = tp), "
    f"pc AS MATERIALIZED (SELECT *, {PARTY_CATEGORY.format("upper(label || ' ' || category || ' ' || narration)")} AS party_category FROM pt)\n"
)
over_txns(
    "party_labels",
    lambda t: ledger.with_party(t).select("account_id", "seq", "party_name", "label", "confidence", "party_category", "fine_mode", "txn_party_type"),
    PARTY + "SELECT account_id, seq, CASE WHEN shape = 4 THEN 'EMI PAYMENT' ELSE label END AS party_name, label, CAST(confidence AS DOUBLE) AS confidence, party_category, fine_mode, "
    + PARTY_TYPE.format("label") + " AS txn_party_type FROM pc",
)
over_txns(
    "party_aliases",
    lambda t: ledger.with_party(t).select("account_id", "seq", "narration_alias", "alias_label"),
    PARTY + ", al AS (SELECT account_id, seq, CASE shape WHEN 1 THEN 'HDFC ' || pname WHEN 4 THEN pname || ' EMI' WHEN 8 THEN 'SMS' ELSE label END AS a FROM pc) SELECT account_id, seq, a AS narration_alias, a AS alias_label FROM al",
)
over_txns("cluster_labels", lambda t: ledger.labelled_rows(t, ())[1], PARTY + "SELECT DISTINCT account_id, label, party AS canonical FROM pt")
SUMMARY = (
    PARTY
    + ", ct AS (SELECT account_id, party, party_category, count(*) AS n, min(seq) AS f FROM pc GROUP BY ALL), "
    "best AS (SELECT account_id, party, party_category AS category FROM (SELECT *, row_number() OVER (PARTITION BY account_id, party ORDER BY n DESC, f) AS r FROM ct) WHERE r = 1)\n"
    f"SELECT pc.account_id, pc.party, count(*) AS txn_count, {D('sum(debit)')} AS debit, {D('sum(credit)')} AS credit, {D('sum(credit) - sum(debit)')} AS net, "
    "array_to_string(list_sort(list_distinct(list(fine_mode))), ',') AS modes, coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (label <> pc.party))), ','), '') AS aliases, "
    "any_value(best.category) AS category, CAST(floor(sum(confidence) / count(*)::DOUBLE + 0.5) AS BIGINT) AS confidence, any_value(" + PARTY_TYPE.format("pc.party") + ") AS party_type "
    "FROM pc JOIN best ON pc.account_id = best.account_id AND pc.party = best.party GROUP BY pc.account_id, pc.party"
)
over_txns(
    "party_ledger_full",
    lambda t: modules.transactions_summary(t).select("account_id", "party", "txn_count", "debit", "credit", "net", F.array_join("modes", ",").alias("modes"), F.array_join("aliases", ",").alias("aliases"), "category", "confidence", "party_type"),
    SUMMARY,
)
over_txns(
    "party_summary",
    lambda t: ledger.ranked(ledger.party_ledger(t)).select("account_id", "rank", "party", "txn_count", "debit", "credit", "category", "party_type"),
    f"SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY txn_count DESC, CAST(debit AS DECIMAL(18,2)) + CAST(credit AS DECIMAL(18,2)) DESC, party) AS rank, party, txn_count, debit, credit, category, party_type FROM ({SUMMARY})",
)
over_txns(
    "party_detail",
    modules.transactions_detail,
    PARTY
    + f"SELECT account_id, party, 1 AS outline_level, CAST(row_number() OVER (PARTITION BY account_id, party ORDER BY seq) AS INTEGER) AS row_no, strftime(txn_date, '%Y-%m-%d') AS date_text, fine_mode, narration, {D('debit')} AS debit, {D('credit')} AS credit FROM pc",
)
over_txns(
    "ledger_book",
    modules.ledger_book,
    PARTY
    + "SELECT account_id, seq AS voucher_no, strftime(txn_date, '%Y-%m-%d') AS date_text, CASE WHEN debit > 0 THEN 'Cr' ELSE 'Dr' END AS side, party, label AS original_party, "
    + COUNTER.format("upper(fine_mode || ' ' || party_category || ' ' || narration)")
    + f" AS counter_ledger, CASE WHEN debit > 0 THEN 0.0::DOUBLE ELSE {D('credit')} END AS debit, CASE WHEN debit > 0 THEN {D('debit')} ELSE 0.0::DOUBLE END AS credit FROM pc",
    facts=lambda spark, d: unnumbered(spark, d).select("account_id", "seq", "txn_date", "narration", "debit", "credit", "mode", "category"),
)


def _names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.upper(F.concat_ws(" ", "p_type", "p_name")).alias("name")).distinct()
    return p.union(p.select(F.regexp_replace("name", r"^(\S+)\S(\s)", "$1$2").alias("name"))).distinct()


@query(
    "name_similarity_pairs",
    """WITH p AS (SELECT DISTINCT upper(p_type || ' ' || p_name) AS name FROM part), n AS (SELECT name FROM p UNION SELECT regexp_replace(name, '^(\\S+)\\S(\\s)', '\\1\\2') FROM p),
w AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS x FROM n), k AS (SELECT name, count(*) AS c FROM w GROUP BY name),
hit AS (SELECT DISTINCT a.name AS a, b.name AS b, a.x FROM w a JOIN w b ON a.name < b.name AND (a.x = b.x OR (length(a.x) >= 5 AND length(b.x) >= 5 AND 1 - levenshtein(a.x, b.x)::DOUBLE / greatest(length(a.x), length(b.x)) >= 0.84)))
SELECT h.a, h.b FROM (SELECT a, b, count(*) AS m FROM hit GROUP BY a, b) h JOIN k x ON x.name = h.a JOIN k y ON y.name = h.b WHERE h.m::DOUBLE / greatest(x.c, y.c) >= 0.85""",
)
def name_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of alike names.  Candidates share a word, or a piece of three letters
    of a word long enough to match by edit distance; each (name, piece) is one row."""
    n = _names(spark, d)
    w = n.select("name", F.explode(F.array_distinct(c.words(F.col("name")))).alias("x"))
    pieces = w.filter(F.length("x") >= 7).select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 2), lambda i: F.substr("x", i, F.lit(3)))).alias("k"))
    keys = w.select("name", F.concat(F.lit("="), "x").alias("k")).union(pieces).distinct()
    a, b = keys.select(F.col("name").alias("a"), "k"), keys.select(F.col("name").alias("b"), "k")
    pairs = a.join(b, "k").filter("a < b").select("a", "b").distinct()
    return pairs.filter(c.word_overlap(F.col("a"), F.col("b")) >= 0.85)


# --- overrides: assignments when seq % 17 = 0 to party seq % 5, excluded when seq % 34 = 0 ----

SETS = TXN + ", pa AS (SELECT DISTINCT account_id, unnest(range(5)) AS party_id FROM txn), parties AS (SELECT account_id, party_id, 'PARTY ' || party_id AS name FROM pa), asg AS (SELECT account_id, txn_id, seq % 5 AS assigned_party_id, CASE WHEN seq % 34 = 0 THEN 'excluded' ELSE 'active' END AS status FROM txn WHERE seq % 17 = 0)\n"


def _override_tables(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    parties = t.select("account_id").distinct().select("account_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("party_id"))
    parties = parties.select("*", F.concat(F.lit("PARTY "), F.col("party_id").cast("string")).alias("name"))
    asg = t.filter("seq % 17 = 0").select(
        "account_id", "txn_id", (F.col("seq") % 5).alias("assigned_party_id"), F.when(F.col("seq") % 34 == 0, "excluded").otherwise("active").alias("status")
    )
    return asg, parties


over_txns(
    "hydrate_overrides",
    lambda t: overrides.hydrate(t, *_override_tables(t)).select("account_id", "seq", "custom_party", "excluded"),
    TXN + "SELECT account_id, seq, CASE WHEN seq % 17 = 0 THEN 'PARTY ' || (seq % 5) END AS custom_party, seq % 34 = 0 AS excluded FROM txn",
)
PT = SETS + f", tot AS (SELECT txn.account_id, assigned_party_id AS party_id, count(*) AS txn_count, {D('sum(debit)')} AS debit, {D('sum(credit)')} AS credit FROM txn JOIN asg ON txn.account_id = asg.account_id AND txn.txn_id = asg.txn_id WHERE status = 'active' GROUP BY ALL)\n"
over_txns("party_totals", lambda t: overrides.party_totals(t, _override_tables(t)[0]), PT + "SELECT * FROM tot")
over_txns(
    "party_list",
    lambda t: overrides.party_list(_override_tables(t)[1], overrides.party_totals(t, _override_tables(t)[0].filter("assigned_party_id < 3"))),
    PT + "SELECT p.account_id, p.party_id, p.name, CASE WHEN p.party_id < 3 THEN coalesce(txn_count, 0) ELSE 0 END AS txn_count, CASE WHEN p.party_id < 3 THEN coalesce(debit, 0.0) ELSE 0.0 END AS debit, CASE WHEN p.party_id < 3 THEN coalesce(credit, 0.0) ELSE 0.0 END AS credit, "
    "CASE WHEN p.party_id < 3 THEN coalesce(credit, 0.0) - coalesce(debit, 0.0) ELSE 0.0 END AS net FROM parties p LEFT JOIN tot ON p.account_id = tot.account_id AND p.party_id = tot.party_id",
)
over_txns(
    "party_options",
    lambda t: overrides.party_options(_override_tables(t)[1], t.select("account_id", F.when(F.col("seq") % 2 == 0, "party 3").otherwise(F.concat(F.lit("Label "), (F.col("seq") % 9).cast("string"))).alias("label"))),
    SETS + "SELECT account_id, name FROM parties UNION ALL SELECT DISTINCT account_id, 'Label ' || (seq % 9) AS name FROM txn WHERE seq % 2 = 1",
)
for _strategy, _sql in {
    "reassign_unassigned": "SELECT account_id, txn_id, CASE WHEN assigned_party_id = 2 THEN NULL ELSE assigned_party_id END AS assigned_party_id, status FROM asg",
    "reassign_original": "SELECT account_id, txn_id, CASE WHEN assigned_party_id = 2 THEN NULL ELSE assigned_party_id END AS assigned_party_id, status FROM asg WHERE NOT (assigned_party_id = 2 AND status = 'active')",
    "exclude": "SELECT account_id, txn_id, CASE WHEN assigned_party_id = 2 THEN NULL ELSE assigned_party_id END AS assigned_party_id, CASE WHEN assigned_party_id = 2 THEN 'excluded' ELSE status END AS status FROM asg",
}.items():
    over_txns(
        f"delete_party_{_strategy}",
        lambda t, s=_strategy: overrides.delete_party(_override_tables(t)[0], 2, s).withColumn("assigned_party_id", F.col("assigned_party_id").cast("string")),
        SETS + _sql.replace("ELSE assigned_party_id END", "ELSE CAST(assigned_party_id AS VARCHAR) END"),
    )


def _events(t: DataFrame) -> DataFrame:
    """Override events: assigned at 1, excluded at 2, lifted at 3, assigned again at 4, reset at 5."""
    plans = [(11, "assign", "FIRST", 1), (22, "exclude", None, 2), (33, "restore", None, 3), (44, "assign", "SECOND", 4), (55, "reset", None, 5), (13, "exclude", None, 1)]
    parts = [t.filter(f"seq % {k} = 0").select("account_id", "txn_id", F.lit(a).alias("action"), F.lit(p).cast("string").alias("party"), F.lit(at).cast("long").alias("at")) for k, a, p, at in plans]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


over_txns(
    "override_effective",
    lambda t: overrides.effective_assignments(_events(t)),
    TXN + """, e AS (SELECT account_id, txn_id, seq % 55 = 0 AS reset, seq % 44 = 0 AS second, seq % 33 = 0 AS lifted, seq % 22 = 0 AS ex2, seq % 11 = 0 AS first, seq % 13 = 0 AS ex1 FROM txn WHERE seq % 11 = 0 OR seq % 13 = 0)
SELECT account_id, txn_id, CASE WHEN second THEN 'SECOND' WHEN first THEN 'FIRST' END AS party, CASE WHEN ex2 AND NOT (lifted OR second) THEN 'excluded' WHEN ex1 AND NOT ex2 AND NOT (lifted OR second OR first) THEN 'excluded' ELSE 'active' END AS status FROM e WHERE NOT reset""",
)
over_txns(
    "audit_log",
    lambda t: overrides.audit_log(_events(t)).groupBy("account_id", "audit_action").agg(F.count(F.lit(1)).alias("n")),
    TXN + """, v AS (SELECT account_id, unnest([CASE WHEN seq % 11 = 0 THEN 'transaction_reassigned' END, CASE WHEN seq % 22 = 0 THEN 'transaction_excluded' END, CASE WHEN seq % 33 = 0 THEN 'transaction_restored' END,
CASE WHEN seq % 44 = 0 THEN 'transaction_reassigned' END, CASE WHEN seq % 55 = 0 THEN 'transaction_reset' END, CASE WHEN seq % 13 = 0 THEN 'transaction_excluded' END]) AS audit_action FROM txn)
SELECT account_id, audit_action, count(*) AS n FROM v WHERE audit_action IS NOT NULL GROUP BY ALL""",
)


def _resolver_rows(t: DataFrame) -> DataFrame:
    return t.filter("seq % 19 = 0").select(
        "txn_id", F.concat(F.lit("shop #"), (F.col("seq") % 7).cast("string")).alias("party"), F.when(F.col("seq") % 2 == 0, "Sales").alias("ledger"), F.when(F.col("seq") % 3 == 0, F.lit(120.0)).alias("confidence")
    )


over_txns(
    "resolver_apply",
    lambda t: overrides.apply_resolver(t, _resolver_rows(t)).filter("ai_party IS NOT NULL").select("account_id", "seq", "ai_party", "ai_ledger", "ai_confidence"),
    TXN + "SELECT account_id, seq, 'SHOP ' || (seq % 7) AS ai_party, CASE WHEN seq % 2 = 0 THEN 'Sales' ELSE 'Others' END AS ai_ledger, CASE WHEN seq % 3 = 0 THEN 100.0::DOUBLE ELSE 75.0::DOUBLE END AS ai_confidence FROM txn WHERE seq % 19 = 0",
)

# --- report modules ----------------------------------------------------------

over_txns("module_raw_data", modules.raw_data, TXN + f"SELECT account_id, seq AS sn, strftime(txn_date, '%Y-%m-%d') AS date_text, narration, nullif({D('debit')}, 0) AS debit, nullif({D('credit')}, 0) AS credit, {D('balance')} AS balance FROM txn")
over_txns("module_monthly_cashflow", modules.monthly_cashflow, METRICS + "SELECT account_id, month_key, opening_balance, total_credits AS inflow, total_debits AS outflow, net, closing_balance FROM mm")
over_txns("net_transactions", modules.net_transactions, METRICS + "SELECT account_id, month_key, total_credits, total_debits, net, credit_count + debit_count AS txn_count FROM mm")
over_txns("highest_txns", modules.highest_transactions, TXN + f"SELECT account_id, direction, rank, seq, {D('amount')} AS amount FROM (SELECT *, row_number() OVER (PARTITION BY account_id, direction ORDER BY amount DESC, seq) AS rank FROM txn) WHERE rank <= 10")
over_txns(
    "spend_analysis",
    modules.spend_analysis,
    TXN + f", s AS (SELECT account_id, category, sum(debit) AS t, count(*) AS txn_count FROM txn WHERE debit > 0 GROUP BY ALL) SELECT account_id, category, {D('t')} AS total, txn_count, floor(({D('t')} * 100 / {D('sum(t) OVER (PARTITION BY account_id)')} + 2.220446049250313e-16::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS share FROM s",
)
for _side in ("debit", "credit"):
    over_txns(
        f"recurring_{_side}s",
        modules.EXTENSIONS[f"recurring-{_side}s"],
        PARTY + f", r AS (SELECT account_id, party, month_key, count(*) AS n, sum({_side}) AS s FROM pt WHERE {_side} > 0 GROUP BY ALL) SELECT account_id, party, count(*) AS n_months, CAST(sum(n) AS BIGINT) AS txn_count, {D('sum(s)')} AS total FROM r GROUP BY account_id, party HAVING count(*) >= 3",
        facts=unnumbered,
    )
for _name, _cat, _side in (("loans_emi", "Loan & EMI", "debit"), ("salary", "Salary", "credit"), ("staff_emoluments", "Salary", "debit"), ("bill_payments", "Utilities", "debit")):
    over_txns(
        _name,
        modules.EXTENSIONS[_name.replace("_", "-")],
        TXN + f"SELECT account_id, month_key, count(*) AS txn_count, {D(f'sum({_side})')} AS total, floor(({D(f'sum({_side})')} / count(*) + 2.220446049250313e-16::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS mean_amount FROM txn WHERE category = '{_cat}' AND {_side} > 0 GROUP BY ALL",
    )
over_txns(
    "bounce_penal",
    modules.bounce_penal,
    TXN + f"SELECT account_id, month_key, CASE WHEN regexp_matches(upper(narration), 'BOUNCE|RETURN|INSUFFICIENT') THEN 'bounce' ELSE 'penal' END AS kind, count(*) AS txn_count, {D('sum(debit)')} AS total FROM txn WHERE regexp_matches(upper(narration), 'BOUNCE|RETURN|PENAL|INSUFFICIENT|CHARGE') GROUP BY ALL",
)
over_txns("internal_group", modules.internal_group, TXN + f"SELECT account_id, month_key, count(*) AS txn_count, {D('sum(debit)')} AS debit, {D('sum(credit)')} AS credit FROM txn WHERE regexp_matches(upper(narration), '\\bSELF\\b') GROUP BY ALL")
over_txns(
    "circular_flows",
    modules.circular_flows,
    PARTY + f"SELECT i.account_id, i.party, i.seq AS in_seq, o.seq AS out_seq, o.txn_date - i.txn_date AS days, {D('i.credit')} AS in_amount, {D('o.debit')} AS out_amount FROM pt i JOIN pt o ON i.account_id = o.account_id AND i.party = o.party AND i.party <> 'UNRECOGNIZED' AND i.credit > 0 AND o.debit > 0 AND o.txn_date - i.txn_date BETWEEN 0 AND 7",
    facts=unnumbered,
)
over_txns(
    "flags",
    modules.flags,
    METRICS + "SELECT account_id, month_key, flag FROM (SELECT account_id, month_key, unnest([CASE WHEN net < 0 THEN 'negative_net' END, CASE WHEN closing_balance < 0 THEN 'negative_closing' END, CASE WHEN cash_deposit * 2 > total_credits THEN 'cash_heavy' END]) AS flag FROM mm) WHERE flag IS NOT NULL",
)
over_txns(
    "cam_analysis",
    modules.cam_analysis,
    METRICS + ", r AS (SELECT account_id, month_key, count(*) FILTER (regexp_matches(upper(narration), 'BOUNCE|RETURN')) AS return_count FROM txn GROUP BY ALL) SELECT account_id, month_key, total_credits, total_debits, credit_count, debit_count, mean_balance, return_count FROM mm JOIN r USING (account_id, month_key)",
)
over_txns(
    "emi_tracker",
    modules.emi_tracker,
    PARTY + f"SELECT account_id, party AS lender, month_key, count(*) AS txn_count, {D('sum(debit)')} AS total FROM pt WHERE category = 'Loan & EMI' AND debit > 0 GROUP BY ALL",
    facts=unnumbered,
)



def _book(t: DataFrame) -> DataFrame:
    """Rows and sums of a book of modules, all read from facts and sums that are written once."""
    rows = modules.book_rows(t, ["raw-data", "mom-summary", "loans-emi", "salary", "bill-payments", "spend-analysis", "transactions-ledger", "recurring-debits"])
    total = F.get_json_object("row", "$.total").cast("decimal(18,2)")
    return rows.groupBy("module", "account_id").agg(F.count(F.lit(1)).alias("n_rows"), dbl(F.sum(total)).alias("total"))


OF_MONTHS = "SELECT '{0}' AS module, account_id, count(DISTINCT month_key) AS n_rows, sum({2}) AS total FROM txn WHERE category = '{1}' AND {2} > 0 GROUP BY account_id"
over_txns(
    "book_rows",
    _book,
    PARTY + ", book AS (SELECT 'raw-data' AS module, account_id, count(*) AS n_rows, NULL AS total FROM pt GROUP BY account_id UNION ALL SELECT 'transactions-ledger', account_id, count(*), NULL FROM pt GROUP BY account_id "
    "UNION ALL SELECT 'mom-summary', account_id, count(DISTINCT month_key), NULL FROM pt GROUP BY account_id UNION ALL "
    + " UNION ALL ".join(OF_MONTHS.format(*x) for x in (("loans-emi", "Loan & EMI", "debit"), ("salary", "Salary", "credit"), ("bill-payments", "Utilities", "debit"))).replace("FROM txn", "FROM pt")
    + " UNION ALL SELECT 'spend-analysis', account_id, count(DISTINCT category), sum(debit) FROM pt WHERE debit > 0 GROUP BY account_id "
    "UNION ALL SELECT 'recurring-debits', account_id, count(*), sum(t) FROM (SELECT account_id, party, sum(debit) AS t FROM pt WHERE debit > 0 GROUP BY ALL HAVING count(DISTINCT month_key) >= 3) GROUP BY account_id) "
    f"SELECT module, account_id, n_rows, {D('total')} AS total FROM book",
)

# --- scalar functions, sources, sinks ----------------------------------------

GROUPED = "CASE WHEN length({0}) <= 3 THEN {0} WHEN length({0}) <= 5 THEN left({0}, length({0}) - 3) || ',' || right({0}, 3) ELSE left({0}, length({0}) - 5) || ',' || substr({0}, length({0}) - 4, 2) || ',' || right({0}, 3) END"
over_txns(
    "display_amounts",
    lambda t: t.select(
        "account_id", "seq", c.indian_grouped(F.col("amount")).alias("grouped"), c.round2(dbl(F.col("balance")) / 3).alias("third"),
        c.inr(F.col("balance") / F.when(F.col("seq") % 2 == 0, 1).otherwise(500)).alias("shown"), c.axis_tick(F.floor(F.col("amount"))).alias("tick"),
    ),
    TXN + ", g AS (SELECT account_id, seq, balance, CAST(balance AS DOUBLE) / CASE WHEN seq % 2 = 0 THEN 1 ELSE 500 END AS x, floor(CAST(amount AS DOUBLE)) AS t, CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR) AS w FROM txn), h AS (SELECT *, abs(x) AS v, CAST(CAST(floor(abs(x) + 0.5) AS BIGINT) AS VARCHAR) AS r FROM g) SELECT account_id, seq, "
    + GROUPED.format("w") + " AS grouped, floor((CAST(balance AS DOUBLE) / 3 + 2.220446049250313e-16::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE AS third, "
    "CASE WHEN x < 0 THEN '-' ELSE '' END || 'Rs ' || CASE WHEN v >= 1e7 THEN printf('%.2f', floor(v / 1e7 * 100 + 0.5) / 100) || ' Cr' WHEN v >= 1e5 THEN printf('%.2f', floor(v / 1e5 * 100 + 0.5) / 100) || ' L' ELSE " + GROUPED.format("r") + " END AS shown, "
    "CASE WHEN t >= 1e5 THEN printf('%.1fL', floor(t / 1e4 + 0.5) / 10) WHEN t >= 1e3 THEN printf('%.0fK', floor(t / 1e3 + 0.5)) ELSE printf('%.0f', t) END AS tick FROM h",
)
DAYS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MMM-yy", "d.M.yy"]


@query("parse_dates", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in one of four ways and read back."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("x"))
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, F.date_format("x", f)) for i, f in enumerate(DAYS)])
    return o.select("o_orderkey", F.date_format(c.parsed_date(text), "yyyy-MM-dd").alias("day"))


@query("parse_amounts", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value FROM orders")
def parse_amounts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    text = F.concat(c.indian_grouped(F.col("x")), F.lit("."), F.lpad(((F.col("x") * 100) % 100).cast("int").cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 2 == 0, " Dr").otherwise(" Cr"))
    return o.select("o_orderkey", dbl(c.amount_of_text(text)).alias("value"))


@query("export_names", "SELECT c_custkey, replace(c_name, '#', '_') || '_' || c_mktsegment[1:1] || lower(c_mktsegment[2:]) || '_' || right(CAST(c_custkey AS VARCHAR), 4) AS file_name FROM customer")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "customer")
    return k.select("c_custkey", export_name(F.col("c_name"), F.col("c_mktsegment"), F.right(F.col("c_custkey").cast("string"), F.lit(4)), F.lit(None).cast("string")).alias("file_name"))


@query("daily_event_totals", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def daily_event_totals(spark: SparkSession, d: str) -> DataFrame:
    """The plan of the streaming extension over the whole table."""
    t = daily_totals(table(spark, d, "events"))
    return t.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"))


@query(
    "parse_lines",
    TXN + f"SELECT 'account-' || account_id AS file_id, seq - 1 AS row_no, strftime(txn_date, '%Y-%m-%d') AS day, {D('nullif(debit, 0)')} AS withdrawal, {D('nullif(credit, 0)')} AS deposit, {D('balance')} AS balance FROM txn",
)
def parse_lines(spark: SparkSession, d: str) -> DataFrame:
    """Statements of all accounts written as lines and parsed back."""
    got = parsing.parse_lines(statement_lines(transactions(spark, d)))
    return got.select("file_id", F.col("row_no").cast("long").alias("row_no"), F.date_format("txn_date", "yyyy-MM-dd").alias("day"), "withdrawal", "deposit", "balance")


def statement_documents(t: DataFrame) -> DataFrame:
    """One document a month and account, as extraction services write them: text
    dates in several forms, rows without a date or an amount, and account labels."""
    n = F.row_number().over(Window.partitionBy("account_id", "month_key").orderBy("seq"))
    day = F.when(F.col("seq") % 23 == 0, "n/a").when(F.col("seq") % 2 == 0, F.date_format("txn_date", "dd/MM/yyyy")).otherwise(F.date_format("txn_date", "yyyy-MM-dd"))
    gone = F.col("seq") % 29 == 0
    amount = lambda x: F.when(gone, 0.0).otherwise(dbl(F.col(x)))
    row = F.struct(
        F.when(F.col("seq") % 3 == 0, F.col("narration")).alias("particulars"), F.col("narration"), day.alias("date"), amount("debit").alias("withdrawal"), amount("credit").alias("deposit"),
        F.when(F.col("seq") % 7 != 0, dbl(F.col("balance"))).alias("balance"),
    )
    parts = t.withColumn("_n", n).groupBy("account_id", "month_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    kind = F.col("account_id") % 3
    said = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    entries = F.when(kind == 0, F.array(said("Bank Name", F.lit("HDFC BANK LTD, Fort")), said("Account Number", F.concat(F.lit("00-77"), F.lpad(F.col("account_id").cast("string"), 4, "0"))))).when(
        kind == 1, F.array(said("IFSC", F.lit("SBIN0001234")), said("Customer Name", F.lit("Alpha Person")))
    ).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    statement = F.struct(F.lit("icici_2024.pdf").alias("fileName"), entries.alias("accountInfo"), F.col("rows").alias("transactions"))
    return parts.select(F.concat_ws("/", F.col("account_id").cast("string"), "month_key").alias("analysis_id"), F.lit("The Applicant").alias("applicantName"), F.array(statement).alias("statements"))


over_txns(
    "normalize_statements",
    lambda t: as_doubles(normalize.normalize(statement_documents(t)).drop("seq", "stmt_idx", "txn_idx")),
    TXN + f"""SELECT account_id || '/' || month_key AS analysis_id, '1-' || n AS txn_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, strftime(txn_date, '%Y-%m-%d') AS date_text, narration, {D('debit')} AS debit, {D('credit')} AS credit,
{D('CASE WHEN seq % 7 <> 0 THEN balance END')} AS balance, CASE account_id % 3 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'State Bank of India' ELSE 'ICICI Bank' END AS bank_name,
CASE account_id % 3 WHEN 0 THEN lpad(CAST(account_id AS VARCHAR), 4, '0') END AS account_suffix, CASE account_id % 3 WHEN 1 THEN 'Alpha Person' ELSE 'The Applicant' END AS holder,
direction, {D('amount')} AS amount, month_key, month, mode, category FROM (SELECT *, row_number() OVER (PARTITION BY account_id, month_key ORDER BY seq) AS n FROM txn) WHERE seq % 23 <> 0 AND seq % 29 <> 0""",
)


def two_statements(t: DataFrame) -> DataFrame:
    """One document an account with two statements of the same days: rows of odd number in the first,
    of even number in the second, so that both share most of their days."""
    row = F.struct(F.col("narration").alias("particulars"), F.col("narration"), F.date_format("txn_date", "yyyy-MM-dd").alias("date"), dbl(F.col("debit")).alias("withdrawal"), dbl(F.col("credit")).alias("deposit"), dbl(F.col("balance")).alias("balance"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("r")))), lambda x: x["r"])
    parts = t.groupBy("account_id", (F.col("seq") % 2 == 0).cast("int").alias("i")).agg(listed.alias("rows"))
    none = F.array().cast("array<struct<label:string,value:string>>").alias("accountInfo")
    statement = F.struct(F.concat(F.lit("part"), F.col("i").cast("string"), F.lit(".pdf")).alias("fileName"), none, F.col("rows").alias("transactions"))
    both = parts.groupBy("account_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", statement.alias("s")))), lambda x: x["s"]).alias("statements"))
    return both.select(F.col("account_id").cast("string").alias("analysis_id"), F.lit("The Applicant").alias("applicantName"), "statements")


def _in_order(t: DataFrame) -> DataFrame:
    rows = normalize.normalize(two_statements(t))
    place = F.row_number().over(Window.partitionBy("analysis_id").orderBy("seq")).cast("long")
    return rows.select("analysis_id", "txn_id", place.alias("place"), F.date_format("txn_date", "yyyy-MM-dd").alias("day"), dbl(F.col("amount")).alias("amount"))


over_txns(
    "normalize_two_statements",
    _in_order,
    TXN + f""", n AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END AS stmt, (seq + 1) // 2 AS idx FROM txn)
SELECT CAST(account_id AS VARCHAR) AS analysis_id, stmt || '-' || idx AS txn_id, row_number() OVER (PARTITION BY account_id ORDER BY txn_date, stmt, idx) AS place, strftime(txn_date, '%Y-%m-%d') AS day, {D('amount')} AS amount FROM n""",
)


def statement_lines(t: DataFrame) -> DataFrame:
    """A line table as a text extraction would give: header, opening, rows."""
    two = lambda x: F.format_string("%.2f", dbl(x))
    row = F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), "narration", two(F.col("amount")), two(F.col("balance")))
    file_id = F.concat(F.lit("account-"), F.col("account_id").cast("string")).alias("file_id")
    none = F.lit(None).cast("array<struct<x:double,text:string>>").alias("items")
    page = F.lit(1).alias("page_no")
    body = t.select(file_id, page, (F.col("seq") + 2).cast("int").alias("line_no"), row.alias("text"), none)
    files = t.select("account_id").distinct()
    head = files.select(file_id, page, F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("Date Particulars Amount").alias("t")), F.struct(F.lit(2).alias("n"), F.lit("OPENING BALANCE 0.00").alias("t")))).alias("x"), none)
    return body.unionByName(head.select("file_id", "page_no", F.col("x.n").alias("line_no"), F.col("x.t").alias("text"), "items"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["month_metrics"](spark, d)


__all__ = ["ORACLES", "QUERIES", "flagship", "raw_transactions"]
