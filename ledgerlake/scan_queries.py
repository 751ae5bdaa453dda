"""Registered queries over noisy and column-wise statements, with SQL of their own.

The statements are written from the transactions of the test tables, damaged by a stated rule,
and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import anchors, columnar
from .operators.metrics import dbl
from .queries import TXN, D, over_txns

# --- carried anchor: foreign lines, unread lines, a lost row, a printed opening or none ----------


def noisy_rows(t: DataFrame) -> DataFrame:
    """Three places a row: the row itself, a foreign line after every seventh, an unread line after
    every eleventh; accounts that end in 3 lose row 50, one account in four prints no opening balance."""
    opening = F.when(F.col("account_id") % 4 != 1, F.lit(0).cast("decimal(18,2)")).alias("opening")
    row = lambda place, balance, amount: t.select("account_id", (F.col("seq") * 3 + place).alias("seq"), balance.cast("decimal(18,2)").alias("balance"), amount.cast("decimal(18,2)").alias("amount"), opening)
    kept = row(0, F.col("balance"), F.col("amount")).filter("NOT (account_id % 10 = 3 AND seq = 150)")
    foreign = row(1, F.col("balance") + F.lit(1000.37), F.col("amount") + F.lit(0.5)).filter("(seq - 1) % 21 = 0")
    unread = row(2, F.lit(None), F.col("amount")).filter("(seq - 2) % 33 = 0")
    return kept.unionByName(foreign).unionByName(unread)


over_txns(
    "reconcile_carried",
    lambda t: anchors.reconcile_carried(noisy_rows(t), F.col("opening")).select("account_id", "seq", "status"),
    TXN + """, noisy AS (
  SELECT account_id, seq * 3 AS n, balance, amount FROM txn WHERE NOT (account_id % 10 = 3 AND seq = 50)
  UNION ALL SELECT account_id, seq * 3 + 1, CAST(balance + 1000.37 AS DECIMAL(18,2)), CAST(amount + 0.5 AS DECIMAL(18,2)) FROM txn WHERE seq % 7 = 0
  UNION ALL SELECT account_id, seq * 3 + 2, NULL, amount FROM txn WHERE seq % 11 = 0),
listed AS (
  SELECT account_id, list(n ORDER BY n) AS ns, list({'b': CAST(balance * 100 AS BIGINT), 'a': CAST(amount * 100 AS BIGINT), 's': ''} ORDER BY n) AS rows,
         CASE WHEN account_id % 4 <> 1 THEN 0 ELSE arg_min(CAST(balance * 100 AS BIGINT), n) FILTER (balance IS NOT NULL) END AS opening
  FROM noisy GROUP BY account_id),
judged AS (
  SELECT account_id, ns, list_reduce(rows, lambda acc, x: CASE WHEN x.b IS NULL OR x.a IS NULL THEN {'b': acc.b, 'a': acc.a, 's': acc.s || 'u'}
    WHEN abs(x.b - acc.b - x.a) <= 5 THEN {'b': x.b, 'a': acc.a, 's': acc.s || 'd'} WHEN abs(x.b - acc.b + x.a) <= 5 THEN {'b': x.b, 'a': acc.a, 's': acc.s || 'w'}
    ELSE {'b': acc.b, 'a': acc.a, 's': acc.s || 's'} END, {'b': opening, 'a': CAST(0 AS BIGINT), 's': ''}).s AS said FROM listed),
each AS (SELECT account_id, unnest(ns) AS seq, unnest(string_split(said, '')) AS c FROM judged)
SELECT account_id, seq, CASE c WHEN 'd' THEN 'deposit' WHEN 'w' THEN 'withdrawal' WHEN 's' THEN 'skipped' ELSE 'unread' END AS status FROM each""",
    keep="account_id seq balance amount",
)


def foreign_rows(t: DataFrame) -> DataFrame:
    """The rows and a foreign line after every seventh that no amount explains: its balance is off by more than its
    amount.  (A line of noisy_rows is off by a fixed sum, and some row of a large table has just that amount.)"""
    rows = noisy_rows(t.filter("NOT (account_id % 10 = 3)")).filter("seq % 3 <> 2")
    return rows.withColumn("balance", F.when(F.col("seq") % 3 == 1, F.col("balance") + 2 * F.col("amount")).otherwise(F.col("balance")).cast("decimal(18,2)"))


over_txns(
    "reconcile_carried_counts",
    lambda t: anchors.skipped_counts(anchors.reconcile_carried(foreign_rows(t), F.col("opening"))),
    TXN + """, n AS (SELECT account_id, count(*) AS good, count(*) FILTER (seq % 7 = 0) AS bad FROM txn WHERE account_id % 10 <> 3 GROUP BY account_id)
SELECT account_id, good + bad AS n_rows, good - CASE WHEN account_id % 4 = 1 THEN 1 ELSE 0 END AS n_accepted, bad + CASE WHEN account_id % 4 = 1 THEN 1 ELSE 0 END AS n_skipped, CAST(0 AS BIGINT) AS n_unread FROM n""",
    keep="account_id seq balance amount",
)

# --- column blocks: a page a month; some descriptions lost, others on two lines ------------------

BLOCK = 40_000_000  # line numbers of a page's three blocks begin so far apart


def column_lines(t: DataFrame) -> DataFrame:
    """Each account a file and each month a page: dates, descriptions and balances in blocks, the opening
    balance before the first.  The description of a row is lost if the next row of the page has another side
    (or there is none) and seq % 3 = 0; every fifth one is broken in two."""
    file_id = F.concat(F.lit("account-"), F.col("account_id").cast("string")).alias("file_id")
    page = (F.year("txn_date") * 12 + F.month("txn_date")).cast("int").alias("page_no")
    n = F.col("seq").cast("int") * 4
    into = F.col("credit") > 0
    after = F.lead(into).over(Window.partitionBy("account_id", "month_key").orderBy("seq"))
    kept = ~((F.col("seq") % 3 == 0) & (F.col("_after").isNull() | (into != F.col("_after"))))
    words = F.concat_ws(" ", F.when(into, "BY TRF").otherwise("TO TRF"), F.col("seq").cast("string"), F.when(F.col("seq") % 5 != 0, "END"))
    before = F.col("balance") - F.col("credit") + F.col("debit")
    line = lambda at, text: F.struct(at.cast("int").alias("line_no"), text.alias("text"))
    own = [
        line(n + 1, F.date_format("txn_date", "dd/MM/yyyy")),
        F.when(kept, line(n + BLOCK + 1, words)),
        F.when(kept & (F.col("seq") % 5 == 0), line(n + BLOCK + 2, F.lit("END"))),
        F.when(F.col("seq") == 1, line(F.lit(2 * BLOCK + 1), before.cast("decimal(18,2)").cast("string"))),
        line(n + 2 * BLOCK + 1, F.col("balance").cast("string")),
    ]
    heads = [line(F.lit(k * BLOCK), F.lit(x)) for k, x in enumerate(("TRANS DATE", "DESCRIPTION", "BALANCE"))]
    of = lambda rows, each: rows.select(file_id, page, F.explode(F.array(*each)).alias("x")).filter("x IS NOT NULL").select("file_id", "page_no", "x.line_no", "x.text")
    pages = t.groupBy("account_id", F.trunc("txn_date", "month").alias("txn_date")).agg(F.lit(1).alias("one"))
    return of(t.withColumn("_after", after), own).unionByName(of(pages, heads))


def shown(found: DataFrame) -> DataFrame:
    return found.select(
        "file_id", F.col("page").cast("long").alias("page"), F.col("k").cast("long").alias("k"), F.date_format("txn_date", "yyyy-MM-dd").alias("day"), "particulars",
        dbl(F.col("withdrawal")).alias("withdrawal"), dbl(F.col("deposit")).alias("deposit"), dbl(F.col("balance")).alias("balance"),
    )


COLUMNS = TXN + """, page AS (SELECT *, dense_rank() OVER (PARTITION BY account_id ORDER BY month_key) AS page, row_number() OVER w AS k, lead(credit > 0) OVER w AS next_in
  FROM txn WINDOW w AS (PARTITION BY account_id, month_key ORDER BY seq)),
said AS (SELECT *, NOT (seq % 3 = 0 AND (next_in IS NULL OR next_in <> (credit > 0))) AS kept, CASE WHEN credit > 0 THEN 'BY TRF ' ELSE 'TO TRF ' END || seq || ' END' AS words FROM page)
SELECT 'account-' || a.account_id AS file_id, a.page, a.k, strftime(a.txn_date, '%Y-%m-%d') AS day, coalesce({words}, 'TRANSACTION') AS particulars,
  """ + f"{D('CASE WHEN a.debit > 0 THEN a.debit END')} AS withdrawal, {D('CASE WHEN a.credit > 0 THEN a.credit END')} AS deposit, {D('a.balance')} AS balance FROM said a"
over_txns("column_blocks_aligned", lambda t: shown(columnar.transactions(column_lines(t), most=1e12)), COLUMNS.replace("{words}", "CASE WHEN a.kept THEN a.words END"), keep="account_id seq txn_date debit credit balance month_key")
over_txns(
    "column_blocks_by_number",
    lambda t: shown(columnar.transactions(column_lines(t), by="by_number", most=1e12)),
    COLUMNS.replace("{words}", "b.words")
    + " LEFT JOIN (SELECT account_id, page, words, row_number() OVER (PARTITION BY account_id, page ORDER BY seq) AS k FROM said WHERE kept) b ON b.account_id = a.account_id AND b.page = a.page AND b.k = a.k",
    keep="account_id seq txn_date debit credit balance month_key",
)
