"""Registered queries of single rules: names, texts, party changes, layouts and
sinks, each over the whole tables, with the same in DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as c
from .functions import names
from .functions import tables as t
from .operators import ledger, normalize, overrides, parsing, resolver, scope
from .operators.metrics import dbl
from .plans import modules
from .queries import MONTH, PARTY, SETS, TXN, D, _events, _override_tables, over_txns, query, statement_documents
from .sources.adapter import table
from .sources.sinks import as_document, sheet_names

NUL = "NULL::VARCHAR"

# --- the ladder over narrations of many kinds ---------------------------------

#: Narration (a part's name for {p}, a reference for {r}), entity and confidence.
SHAPES = [
    ("UPI SETTLEMENT -WW8951- 03/04/24", "UPI SETTLEMENT", 85),
    ("MOB ZOMATO {r}", "ZOMATO", 95),
    ("TRANSFER TO SELF", "SELF / INTERNAL TRANSFER", 80),
    ("SWEEP TRF TO FD {r}", "BANK SWEEP", 85),
    ("CASH DEPOSIT BY - {p} - MUMBAI", "{p}", 92),
    ("SI HDFC12345678 {p}", "{p}", 85),
    ("NFS/CASH WDL/{r}", "ATM WITHDRAWAL", 85),
    ("AMAZON PAY INDIA", "AMAZON", 95),
    ("ATM_WDL_DECL {r}", "ATM DECLINED", 85),
    ("IMPS/{r}/CRED CLUB", "CRED", 95),
    ("{p} EMI", "EMI PAYMENT", 80),
    ("QUARTERLY INTEREST", "BANK INTEREST", 85),
    ("* CLOSING BALANCE INCLUDES FUNDS", "UNRECOGNIZED", 0),
    ("UPI/{p}/{r}/PAYMENT", "{p}", 90),
    ("NEFT/{p} LTD/{r}", "{p} LTD", 98),
    ("YOU ARE NOT THE OWNER OF THIS", "UNRECOGNIZED", 0),
]


def shaped(parts: list[str]) -> Column:
    """The text of a shape by seq, with the part's name and a reference filled in."""
    fill = lambda x: F.regexp_replace(F.regexp_replace(F.lit(x), r"\{p\}", F.col("p")), r"\{r\}", F.col("r"))
    return F.coalesce(*[F.when(F.col("seq") % len(parts) == k, fill(x)) for k, x in enumerate(parts)])


def shaped_sql(parts: list[str]) -> str:
    one = lambda x: "replace(replace('" + x.replace("'", "''") + "', '{p}', pname), '{r}', CAST(100000 + seq AS VARCHAR))"
    return f"CASE seq % {len(parts)} " + " ".join(f"WHEN {k} THEN {one(x)}" for k, x in enumerate(parts)) + " END"


def _shapes(t_: DataFrame) -> DataFrame:
    """A narration of each kind for every transaction; the part's name is read back from the narration."""
    strip = r"^(UPI-|NEFT DR-HDFC0001234-|IMPS/P2A/[0-9]+/|ACH D- |CHQ PAID-|SALARY |RENT |ELECTRICITY BILL )|(-[0-9]+@ybl| EMI| TRADERS)$"
    named = t_.filter("NOT narration IN ('CASH DEPOSIT SELF', 'GST PAYMENT', 'SMS_CHARGE_FOR_JAN25')").select(
        "account_id", "seq", F.regexp_replace("narration", strip, "").alias("p"), (F.col("seq") + 100000).cast("string").alias("r")
    )
    return named.withColumn("text", shaped([x for x, *_ in SHAPES]))


over_txns(
    "ladder_shapes",
    lambda x: _shapes(x).withColumn("f", ledger.resolved(F.lit(""), F.col("text"))).select("account_id", "seq", "text", F.col("f.entity").alias("entity"), F.col("f.confidence").cast("long").alias("confidence")),
    TXN + f"SELECT account_id, seq, {shaped_sql([x for x, *_ in SHAPES])} AS text, {shaped_sql([x for _, x, _ in SHAPES])} AS entity, CASE seq % {len(SHAPES)} "
    + " ".join(f"WHEN {k} THEN {n}" for k, (*_, n) in enumerate(SHAPES)) + " END AS confidence FROM txn WHERE shape NOT IN (3, 7, 8)",
)

FORMS = T.StructType([T.StructField("normalized", T.StringType()), T.StructField("key", T.StringType()), T.StructField("shown", T.StringType()), T.StructField("score", T.LongType())])


@F.pandas_udf(FORMS)
def forms(label: pd.Series) -> pd.DataFrame:
    rows = [(n := names.normalized(x), names.cluster_key(x), names.display(x), names.score(n)) for x in label]
    return pd.DataFrame(rows, columns=[f.name for f in FORMS])


@query(
    "name_forms",
    """WITH n AS (SELECT DISTINCT upper(p_type || ' ' || p_name) AS b, p_partkey % 5 AS k FROM part), w AS (SELECT *, len(string_split(b, ' ')) AS c, CASE WHEN length(string_split(b, ' ')[-1]) < 4 THEN '9' ELSE '' END AS tail FROM n)
SELECT b || CASE k WHEN 0 THEN ' Pvt. Ltd' WHEN 1 THEN ' (Vasai)' WHEN 2 THEN ' HDFC' WHEN 3 THEN ' 123456789' ELSE '9' END AS label,
b || CASE k WHEN 0 THEN ' PVT LTD' WHEN 1 THEN ' VASAI' WHEN 2 THEN ' HDFC' WHEN 4 THEN tail ELSE '' END AS normalized, b || CASE k WHEN 0 THEN ' PVT LTD' WHEN 4 THEN tail ELSE '' END AS key, b || CASE k WHEN 0 THEN ' PVT LTD' WHEN 4 THEN tail ELSE '' END AS shown,
least(98, least(70, 45 + 8 * (c + CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END)) + CASE WHEN k = 0 THEN 20 ELSE 0 END + 15) AS score FROM w WHERE c + 2 <= 6""",
)
def name_forms(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form, cluster key, shown name and score of names written in several ways."""
    n = table(spark, d, "part").select(F.upper(F.concat_ws(" ", "p_type", "p_name")).alias("b"), (F.col("p_partkey") % 5).alias("k")).distinct()
    n = n.filter(F.size(F.split("b", " ")) + 2 <= names.LONGEST)
    end = F.coalesce(*[F.when(F.col("k") == k, x) for k, x in enumerate([" Pvt. Ltd", " (Vasai)", " HDFC", " 123456789", "9"])])
    return n.select(F.concat("b", end).alias("label")).withColumn("f", forms("label")).select("label", "f.*")


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


over_txns(
    "token_rules",
    lambda x: x.select(F.explode(F.split(F.upper("narration"), "[^A-Z0-9.&]+")).alias("w")).filter("w != ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")).select(
        "w", "n", c.is_reference_code(F.col("w")).alias("reference"), c.is_party_word(F.col("w")).alias("party_word"), F.array_join(c.party_words(F.col("w")), " ").alias("words")
    ),
    TXN + """, k AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(upper(narration), '[^A-Z0-9.&]+')) AS w FROM txn) WHERE w <> '' GROUP BY w),
r AS (SELECT *, regexp_matches(w, '^[0-9]{2,}$') OR w IN ('HDFC0001234', 'JAN25') AS reference FROM k),
q AS (SELECT *, NOT reference AND w NOT IN ('DR', 'PAYMENT', 'CHQ', 'CHARGE', 'FOR', 'ACH', 'NEFT', 'PAID', 'IMPS', 'CASH', 'P2A', 'YBL', 'D', 'UPI') AS party_word FROM r)
SELECT w, n, reference, party_word, CASE WHEN party_word THEN w ELSE '' END AS words FROM q""",
)
NOTES = ["", " | STATEMENT PERIOD : 2024-01-01 TO 2024-02-01", "  REGD. OFFICE ALPHA TOWER", " | VALUE DA", " DEAR CUSTOMER READ THIS"]
over_txns(
    "clean_text",
    lambda x: x.select("account_id", "seq", F.concat("narration", F.coalesce(*[F.when(F.col("seq") % 5 == k, F.lit(n)) for k, n in enumerate(NOTES)])).alias("raw")).select(
        "account_id", "seq", c.clean_narration(F.col("raw")).alias("cleaned"), c.without_boilerplate(c.clean_narration(F.col("raw"))).alias("bare"), c.reads_like_sentence(F.col("raw")).alias("sentence")
    ),
    TXN + "SELECT account_id, seq, narration || CASE seq % 5 WHEN 2 THEN ' REGD. OFFICE ALPHA TOWER' WHEN 4 THEN ' DEAR CUSTOMER READ THIS' ELSE '' END AS cleaned, narration AS bare, false AS sentence FROM txn",
)
SAID = ["YOU ARE NOT THE HOLDER", "IF IT IS SENT", "PAID TO THE SHOP BY CARD", "IS IT", "the money that you have sent was not in your bank", "ON OF ALPHA BETA GAMMA"]
over_txns(
    "sentences",
    lambda x: x.select("account_id", "seq", c.reads_like_sentence(F.concat_ws(" ", F.coalesce(*[F.when(F.col("seq") % 6 == k, F.lit(n)) for k, n in enumerate(SAID)]), F.when(F.floor(F.col("seq") / 6) % 2 == 0, F.lit("ALPHA BETA")))).alias("sentence")),
    TXN + """SELECT account_id, seq, CASE seq % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN (seq // 6) % 2 = 0 WHEN 4 THEN true ELSE (seq // 6) % 2 <> 0 END AS sentence FROM txn""",
)


@query(
    "name_variants",
    """WITH n AS (SELECT DISTINCT upper(p_name) AS a FROM part), s AS (SELECT a, split_part(a, ' ', 1) AS f, split_part(a, ' ', 2) AS l FROM n WHERE len(string_split(a, ' ')) = 2),
p AS (SELECT x.a AS a, y.a AS b, x.f AS fa, y.f AS fb, x.l AS la, y.l AS lb FROM s x JOIN s y ON x.a <> y.a AND (x.f = y.f OR x.l = y.l)),
q AS (SELECT *, length(la) >= 3 AND length(lb) >= 3 AND length(la) <> length(lb) AND least(length(la), length(lb))::DOUBLE / greatest(length(la), length(lb)) >= 0.5
 AND (starts_with(la, lb) OR starts_with(lb, la) OR ends_with(la, lb) OR ends_with(lb, la)) AS affix FROM p)
SELECT a, b, la = lb OR (length(la) >= 5 AND length(lb) >= 5 AND 1 - levenshtein(la, lb)::DOUBLE / greatest(length(la), length(lb)) >= 0.84) AS alike, affix,
fa = fb AND (affix OR (length(la) >= 5 AND length(lb) >= 5 AND 1 - levenshtein(la, lb)::DOUBLE / greatest(length(la), length(lb)) >= 0.84)) AS variant,
length(fa) >= 5 AND fa IN (fb, lb) AS alias FROM q""",
)
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rules on pairs of two-word names that share a word: last words alike or one an
    affix of the other, one name a variant, the first word an alias of the other name."""
    n = table(spark, d, "part").select(F.upper("p_name").alias("a")).distinct().filter(F.size(F.split("a", " ")) == 2)
    s = n.select("a", F.split("a", " ")[0].alias("f"), F.split("a", " ")[1].alias("l"))
    o = s.select(F.col("a").alias("b"), F.col("f").alias("fb"), F.col("l").alias("lb"))
    pairs = s.join(o, F.col("f") == F.col("fb")).union(s.join(o, F.col("l") == F.col("lb"))).filter("a != b").distinct()

    @F.pandas_udf(T.BooleanType())
    def variant(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([names.partial_variant(a.split(), b.split()) for a, b in zip(x, y)], dtype=bool)

    return pairs.select("a", "b", c.words_match(F.col("l"), F.col("lb")).alias("alike"), c.is_close_affix(F.col("l"), F.col("lb")).alias("affix"), variant("a", "b").alias("variant"), c.is_single_word_alias(F.col("f"), F.col("b")).alias("alias"))


over_txns("month_keys", lambda x: x.select("month", "month_key").distinct().select("month", c.key_of_label(F.col("month")).alias("from_label"), c.key_of_label(F.col("month_key")).alias("from_key")), TXN + "SELECT DISTINCT month, month_key AS from_label, month_key AS from_key FROM txn")
over_txns(
    "voucher_types",
    lambda x: x.groupBy(c.voucher_type(F.col("direction"), c.fine_mode(F.col("mode"), F.col("narration"))).alias("voucher"), c.bank_of_code(F.col("narration")).alias("bank")).agg(F.count(F.lit(1)).alias("n")),
    TXN + "SELECT CASE WHEN shape = 3 THEN 'Contra' WHEN direction = 'Credit' THEN 'Receipt' ELSE 'Payment' END AS voucher, NULL::VARCHAR AS bank, count(*) AS n FROM txn GROUP BY ALL",
)
CODES = ["SBIN TRANSFER", "BY UTIB", "TO IDBI", "BARB0MUMBAI", "NO BANK"]
over_txns(
    "banks_of_codes",
    lambda x: x.groupBy(c.bank_of_code(F.coalesce(*[F.when(F.col("seq") % 5 == k, F.lit(n)) for k, n in enumerate(CODES)])).alias("bank"), F.col("account_id")).agg(F.count(F.lit(1)).alias("n")),
    TXN + "SELECT CASE seq % 5 WHEN 0 THEN 'STATE BANK OF INDIA' WHEN 1 THEN 'AXIS BANK' WHEN 3 THEN 'BANK OF BARODA' END AS bank, account_id, count(*) AS n FROM txn GROUP BY ALL",
)
over_txns(
    "rows_of_month",
    lambda x: scope.rows_of_month(
        x.select(
            "account_id", "seq", F.when(F.col("seq") % 5 == 0, F.col("month_key")).alias("month_key"), F.when(F.col("seq") % 5 == 1, F.col("month")).when(F.col("seq") % 5 == 4, F.lit("Month 1")).alias("month"),
            F.when(F.col("seq") % 5 == 2, F.date_format("txn_date", "yyyy-MM-dd")).when(F.col("seq") % 5 == 3, F.date_format("txn_date", "d/MMM/yy")).alias("date_text"),
        ),
        MONTH,
    ).select("account_id", "seq"),
    TXN + f"SELECT account_id, seq FROM txn WHERE month_key = '{MONTH}' AND seq % 5 <> 4",
)
over_txns(
    "listed_rows",
    lambda x: scope.cleaned_rows(x.filter("seq % 2 = 0").select("account_id", "seq", F.when(F.col("seq") % 6 == 0, F.col("txn_id")).when(F.col("seq") % 6 == 2, F.lit("")).alias("id"), F.lit("").alias("party"), "narration"), ("seq",)).select("account_id", "seq", "id", "party"),
    TXN + "SELECT account_id, seq, CASE WHEN seq % 6 = 0 THEN txn_id ELSE 'txn-' || (seq // 2 - 1) END AS id, 'UNRECOGNIZED' AS party FROM txn WHERE seq % 2 = 0",
)
over_txns("scope_report_rows", lambda x: scope.scope_rows(x.select("account_id", "seq", "month_key", F.date_format("txn_date", "yyyy-MM-dd").alias("date_text")), MONTH).select("account_id", "seq"), TXN + f"SELECT account_id, seq FROM txn WHERE month_key = '{MONTH}'")

over_txns(
    "same_month_rows",
    lambda x: scope.same_month(x, "Mar-96").select("account_id", "seq"),
    TXN + "SELECT account_id, seq FROM txn WHERE month_key = '1996-03'",
)
over_txns(
    "cleaned_rows",
    lambda x: scope.cleaned_rows(x.select("account_id", "seq", F.when(F.col("seq") % 3 == 0, F.lit("  ")).when(F.col("seq") % 3 == 1, F.lit("ALPHA ")).alias("party"), F.when(F.col("seq") % 4 != 0, F.col("narration")).alias("narration"))),
    TXN + "SELECT account_id, seq, CASE WHEN seq % 3 = 1 THEN 'ALPHA' ELSE 'UNRECOGNIZED' END AS party, CASE WHEN seq % 4 <> 0 THEN narration ELSE 'Transaction' END AS narration FROM txn",
)
over_txns(
    "excluded_rows",
    lambda x: scope.excluded_only(overrides.hydrate(x, *_override_tables(x))).select("account_id", "seq", "custom_party"),
    SETS + "SELECT txn.account_id, seq, 'PARTY ' || (seq % 5) AS custom_party FROM txn WHERE seq % 34 = 0",
)
over_txns(
    "display_dates",
    lambda x: x.select("account_id", "seq", c.display_date(F.when(F.col("seq") % 5 == 0, "").when(F.col("seq") % 5 == 1, "n/a").otherwise(F.date_format("txn_date", "dd/MM/yyyy"))).alias("shown"),
                       c.date_tokens(F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), "narration", F.date_format("txn_date", "d-M-yy"))).cast("long").alias("n_dates")),
    TXN + "SELECT account_id, seq, CASE seq % 5 WHEN 0 THEN '-' WHEN 1 THEN 'n/a' ELSE strftime(txn_date, '%d-%b-%Y') END AS shown, CAST(2 AS BIGINT) AS n_dates FROM txn",
)
over_txns(
    "applicant_banks",
    lambda x: normalize.applicant_banks(statement_documents(x)).drop("stmt_idx"),
    TXN + """SELECT DISTINCT account_id || '/' || month_key AS analysis_id, CASE account_id % 3 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'State Bank of India' ELSE 'ICICI Bank' END AS bank,
CASE account_id % 3 WHEN 0 THEN '00-77' || lpad(CAST(account_id AS VARCHAR), 4, '0') ELSE 'icici_2024.pdf' END AS account, CASE account_id % 3 WHEN 1 THEN 'SBIN0001234' ELSE '-' END AS ifsc, '-' AS branch FROM txn""",
)
over_txns(
    "one_analysis",
    lambda x: scope.analysis(normalize.normalize(statement_documents(x)), "7/1996-03").select("txn_id", "narration"),
    TXN + "SELECT '1-' || n AS txn_id, narration FROM (SELECT *, row_number() OVER (PARTITION BY account_id, month_key ORDER BY seq) AS n FROM txn) WHERE account_id = 7 AND month_key = '1996-03' AND seq % 23 <> 0 AND seq % 29 <> 0",
)
over_txns(
    "party_outline",
    modules.party_outline,
    PARTY + f"""SELECT account_id, party, 0 AS outline_level, 0 AS row_no, {NUL} AS date_text, {NUL} AS fine_mode, {NUL} AS narration, {D('sum(debit)')} AS debit, {D('sum(credit)')} AS credit FROM pc GROUP BY account_id, party
UNION ALL SELECT account_id, party, 1 AS outline_level, CAST(row_number() OVER (PARTITION BY account_id, party ORDER BY seq) AS INTEGER) AS row_no, strftime(txn_date, '%Y-%m-%d') AS date_text, fine_mode, narration, {D('debit')} AS debit, {D('credit')} AS credit FROM pc""",
)
over_txns(
    "trade_rows",
    modules.trade_rows,
    TXN + f"""SELECT account_id, strftime(txn_date, '%Y-%m-%d') AS date_text, CASE WHEN shape < 3 THEN pname WHEN shape = 5 THEN pname || ' TRADERS' WHEN shape = 8 THEN 'SMS' END AS party, narration, direction, {D('debit')} AS debit, {D('credit')} AS credit
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, category ORDER BY txn_date, seq) AS n FROM txn WHERE category IN ('Trade Credit', 'Trade Debit')) WHERE n <= 100""",
)

# --- changes of parties --------------------------------------------------------


def _fresh(x: DataFrame) -> DataFrame:
    """Names to add: two that exist in another case, a blank one and two new ones."""
    made = [" party 1 ", "Party 3", "  ", "NEW {a}", "new {a}", "Other"]
    each = F.explode(F.array(*[F.regexp_replace(F.lit(n), r"\{a\}", F.col("account_id").cast("string")) for n in made]))
    return x.select("account_id").distinct().select("account_id", each.alias("name"))


over_txns("party_by_id", lambda x: overrides.party(_override_tables(x)[1], 3), SETS + "SELECT account_id, party_id, name FROM parties WHERE party_id = 3")
over_txns(
    "party_added",
    lambda x: overrides.add_parties(_override_tables(x)[1].drop("party_id"), _fresh(x)).select("account_id", F.upper("name").alias("name")),
    SETS + "SELECT account_id, name FROM parties UNION ALL SELECT account_id, unnest(['NEW ' || account_id, 'OTHER']) AS name FROM (SELECT DISTINCT account_id FROM txn)",
)
for _name, _new, _shown in (("party_renamed", " Alpha House ", "'Alpha House'"), ("party_rename_refused", "party 3", "name")):
    over_txns(
        _name,
        lambda x, n=_new: overrides.rename_party(_override_tables(x)[1], 1, n),
        SETS + f"SELECT account_id, party_id, CASE WHEN party_id = 1 THEN {_shown} ELSE name END AS name FROM parties",
    )
over_txns(
    "bulk_assigned",
    lambda x: overrides.bulk_events(x, x.filter("seq % 31 = 0").select("account_id", "txn_id").union(x.filter("seq % 37 = 0").select("account_id", F.lit("none"))), "assign", "ALPHA", 7).withColumnRenamed("at", "at_time"),
    TXN + "SELECT account_id, txn_id, 'assign' AS action, 'ALPHA' AS party, CAST(7 AS BIGINT) AS at_time FROM txn WHERE seq % 31 = 0",
)
CHANGES = " UNION ALL ".join(
    f"SELECT account_id, txn_id, '{a}' AS audit_action, {p} AS became, CAST({at} AS BIGINT) AS at_time FROM txn WHERE seq % 13 <> 0 AND seq % {k} = 0"
    for k, a, p, at in (
        (11, "transaction_reassigned", "'FIRST'", 1),
        (22, "transaction_excluded", NUL, 2),
        (33, "transaction_restored", NUL, 3),
        (44, "transaction_reassigned", "'SECOND'", 4),
        (55, "transaction_reset", NUL, 5),
    )
)
over_txns(
    "audit_detail",
    lambda x: overrides.audit_log(_events(x.filter("seq % 13 != 0"))).select("account_id", "txn_id", "audit_action", F.col("before").alias("was"), F.col("after").alias("became"), F.col("at").alias("at_time")),
    TXN + f", v AS ({CHANGES}) SELECT account_id, txn_id, audit_action, lag(became) OVER (PARTITION BY account_id, txn_id ORDER BY at_time) AS was, became, at_time FROM v",
)


def answers(rows: list[dict]) -> list[dict]:
    """A resolver for the check: refuses narrations of salaries, knows the rest by their last word."""
    if any(r["narration"].startswith("SALARY") for r in rows):
        raise ValueError("refused")
    return [{"txn_id": r["txn_id"], "party": r["narration"].split(" ")[-1], "ledger": "Others", "confidence": 60.0} for r in rows]


over_txns(
    "resolver_asked",
    lambda x: resolver.resolve_parties(x.filter("seq % 19 = 0"), answers).join(x.select("account_id", "seq", "txn_id"), "txn_id").select("account_id", "seq", "party", "ledger", "confidence", "error"),
    TXN + "SELECT account_id, seq, CASE WHEN shape <> 6 THEN string_split(narration, ' ')[-1] END AS party, CASE WHEN shape <> 6 THEN 'Others' END AS ledger, CASE WHEN shape <> 6 THEN 60.0::DOUBLE END AS confidence, CASE WHEN shape = 6 THEN 'ValueError: refused' END AS error FROM txn WHERE seq % 19 = 0",
)

# --- layouts: months of an account written in several tables and read back ------

two = lambda x: F.format_string("%.2f", dbl(x))


def _months(x: DataFrame) -> DataFrame:
    """One statement a month and account: its rows in order, and the balance before."""
    row = F.struct("seq", F.date_format("txn_date", "dd/MM/yyyy").alias("day"), "narration", two(F.col("amount")).alias("a"), two(F.col("balance")).alias("b"))
    before = F.min_by(F.col("balance") - F.col("credit") + F.col("debit"), "seq")
    return x.groupBy("account_id", "month_key").agg(F.sort_array(F.collect_list(row)).alias("rows"), two(before).alias("opening"))


def _written(x: DataFrame, text: Column) -> DataFrame:
    """Arrays of lines as line tables."""
    file_id = F.concat_ws("/", F.col("account_id").cast("string"), "month_key").alias("file_id")
    lines = _months(x).select(file_id, F.posexplode(text).alias("line_no", "text"))
    return lines.select("file_id", F.lit(1).alias("page_no"), "line_no", "text", F.lit(None).cast("array<struct<x:double,text:string>>").alias("items"))


def _column(head: str, name: str) -> Column:
    return F.concat(F.array(F.lit(head)), F.transform("rows", lambda r: r[name]))


def _read(lines: DataFrame) -> DataFrame:
    got = parsing.parse_lines(lines)
    return got.select("file_id", F.col("row_no").cast("long").alias("row_no"), F.date_format("txn_date", "yyyy-MM-dd").alias("day"), "withdrawal", "deposit", "balance")


def split_rows(x: DataFrame) -> DataFrame:
    """Rows come to their file once; each prints its three lines there, the first one also the two of the head."""
    money = lambda a: a.cast("decimal(18,2)").cast("string")
    file_id = F.concat_ws("/", F.col("account_id").cast("string"), "month_key").alias("file_id")
    before = (F.col("balance") - F.col("credit") + F.col("debit")).alias("before")
    rows = x.select(file_id, "seq", F.date_format("txn_date", "dd/MM/yyyy").alias("day"), "narration", "amount", "balance", before)
    i = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
    line = lambda at, text: F.struct(at.alias("line_no"), text.alias("text"))
    head = F.col("i") == 1
    own = [
        F.when(head, line(F.lit(0), F.lit("DCB Bank"))),
        F.when(head, line(F.lit(1), F.concat(F.lit("Opening Balance "), money(F.col("before"))))),
        line(3 * F.col("i") - 1, F.col("day")),
        line(3 * F.col("i"), F.col("narration")),
        line(3 * F.col("i") + 1, F.concat_ws(" ", money(F.col("amount")), money(F.col("balance")))),
    ]
    each = rows.withColumn("i", i).select("file_id", F.explode(F.array(*own)).alias("l")).filter("l IS NOT NULL")
    return _read(each.select("file_id", F.lit(1).alias("page_no"), "l.line_no", "l.text", F.lit(None).cast("array<struct<x:double,text:string>>").alias("items")))


def column_sections(x: DataFrame) -> DataFrame:
    return _read(_written(x, F.concat(_column("TRANS DATE", "day"), _column("DESCRIPTION", "narration"), F.array(F.lit("BALANCE"), F.col("opening")), F.transform("rows", lambda r: r["b"]))))


STATEMENT = TXN + f"SELECT account_id || '/' || month_key AS file_id, row_number() OVER (PARTITION BY account_id, month_key ORDER BY seq) - 1 AS row_no, strftime(txn_date, '%Y-%m-%d') AS day, {D('nullif(debit, 0)')} AS withdrawal, {D('nullif(credit, 0)')} AS deposit, {D('balance')} AS balance FROM txn"
over_txns("layout_split", split_rows, STATEMENT)
over_txns("layout_sections", column_sections, STATEMENT)


def _head(x: DataFrame) -> DataFrame:
    totals = F.concat(F.lit("Grand Total "), two(F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["a"].cast("double"))), F.lit(" 0.00"))
    last = F.concat(F.lit("Closing balance "), F.element_at("rows", -1)["b"])
    first = [F.concat(F.lit("A/C Name : PERSON "), F.col("account_id").cast("string")), F.concat(F.lit("A/C Number : 00"), F.col("account_id").cast("string")), F.lit("IFSC Code : HDFC0001234"), F.concat(F.lit("Scheme : "), F.col("month_key"))]
    return _written(x, F.array(*first, F.lit("Date Particulars Amount"), totals, last))


over_txns(
    "statement_info",
    lambda x: parsing.account_info(_head(x)).select("file_id", F.col("ord").cast("long").alias("ord"), "label", "value"),
    TXN + """, f AS (SELECT DISTINCT account_id, month_key FROM txn) SELECT account_id || '/' || month_key AS file_id, unnest([0, 1, 2, 3, 4, 5]::BIGINT[]) AS ord, unnest(['IFSC Code', 'Account Name', 'Account Number', 'A/C Name', 'A/C Number', 'Scheme']) AS label,
unnest(['HDFC0001234', 'PERSON ' || account_id, '00' || account_id, 'PERSON ' || account_id, '00' || account_id, month_key]) AS value FROM f""",
)
over_txns(
    "statement_printed_totals",
    lambda x: parsing.printed_totals(_head(x)),
    TXN + f"SELECT account_id || '/' || month_key AS file_id, {D('sum(amount)')} AS withdrawal, 0.0::DOUBLE AS deposit, {D('abs(arg_max(balance, seq))')} AS closing_balance FROM txn GROUP BY account_id, month_key",
)


def _items(x: DataFrame) -> DataFrame:
    """Words with coordinates, as a scan gives them: a line's words a little up and down."""
    words = x.select("account_id", "month_key", "seq", F.posexplode(F.split("narration", " ")).alias("k", "text"))
    y = dbl(F.col("seq") * -10) + F.when(F.col("k") % 2 == 0, 0.0).otherwise(1.5)
    return words.select(F.concat_ws("/", F.col("account_id").cast("string"), "month_key").alias("file_id"), F.lit(1).alias("page_no"), (F.col("seq") * 20 + F.col("k")).cast("int").alias("item_no"), dbl(F.col("k") * 50).alias("x"), y.alias("y"), "text")


over_txns(
    "word_lines",
    lambda x: parsing.cluster_items(_items(x)).select("file_id", F.col("line_no").cast("long").alias("line_no"), "text"),
    TXN + "SELECT account_id || '/' || month_key AS file_id, row_number() OVER (PARTITION BY account_id, month_key ORDER BY seq) - 1 AS line_no, narration AS text FROM txn",
)

# --- sinks -----------------------------------------------------------------------


@query(
    "sheet_names",
    "WITH s AS (SELECT p_partkey, left(p_name || '/' || p_type, 28) AS raw, p_name || '/' || p_type AS name FROM part), u AS (SELECT DISTINCT name, rtrim(replace(raw, '/', ' ')) AS sheet FROM s) "
    "SELECT name, CASE WHEN row_number() OVER (PARTITION BY lower(sheet) ORDER BY name) > 1 THEN sheet || ' ' || row_number() OVER (PARTITION BY lower(sheet) ORDER BY name) ELSE sheet END AS sheet FROM u",
)
def sheets(spark: SparkSession, d: str) -> DataFrame:
    return sheet_names(table(spark, d, "part").select(F.concat_ws("/", "p_name", "p_type").alias("name")).distinct(), "name")


@query("documents_out", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS document FROM region")
def documents_out(spark: SparkSession, d: str) -> DataFrame:
    return as_document(table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey")
