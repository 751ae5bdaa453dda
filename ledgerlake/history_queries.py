"""Registered queries over scanned pages, two ledgers and the override log, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import boxes, grid, history, matching
from .operators.metrics import dbl
from .queries import TXN, D, _events, over_txns
from .zip_queries import file_id, put_together

PAGE_SQL = "year(txn_date) * 12 + month(txn_date)"


def page_no() -> Column:
    return (F.year("txn_date") * 12 + F.month("txn_date")).cast("int").alias("page_no")


# --- word boxes on pages that are askew by account: a row every 20 units, a word every 70 --------


def word_boxes(t: DataFrame) -> DataFrame:
    """Rows come to their page before they are cut into words."""
    words = F.split(F.concat_ws(" ", F.date_format("txn_date", "dd/MM/yyyy"), "narration", F.col("amount").cast("string")), " ")
    rows = t.select(file_id(), page_no(), "account_id", "seq", words.alias("words"))
    row = F.row_number().over(Window.partitionBy("file_id", "page_no").orderBy("seq"))
    each = rows.withColumn("row", row).select("file_id", "page_no", "account_id", "seq", "row", F.posexplode("words").alias("k", "text"))
    x = F.col("k") * 70.0
    y = F.col("row") * 20.0 + (x + 30) * F.tan(F.radians((F.col("account_id") % 7 - 3) * 0.5)) + (F.col("seq") + F.col("k")) % 3
    return each.select("file_id", "page_no", x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 10).alias("y1"), "text")


over_txns(
    "lines_of_boxes",
    lambda t: boxes.lines_of_boxes(word_boxes(t)).select("file_id", "page_no", "line_no", "text"),
    TXN + f"""SELECT 'account-' || account_id AS file_id, {PAGE_SQL} AS page_no, row_number() OVER (PARTITION BY account_id, month_key ORDER BY seq) AS line_no,
strftime(txn_date, '%d/%m/%Y') || ' ' || narration || ' ' || amount AS text FROM txn""",
)

# --- orientation: pages of every third account lie upside down -----------------------------------


def _pages(t: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.date_format("txn_date", "dd/MM/yyyy").alias("d")))), lambda x: x["d"]), " ")
    return t.groupBy("account_id", "month_key").agg(text.alias("text"), F.min("txn_date").alias("txn_date")).select(file_id(), page_no(), "text", (F.col("account_id") % 3 == 0).alias("down"), F.col("account_id"))


def _read(pages: DataFrame, rotation: int) -> DataFrame:
    """What a reader sees: upside down, the words of a page are no dates."""
    right = F.col("down") == F.lit(rotation == 180)
    return pages.select("file_id", "page_no", F.when(right, F.col("text")).otherwise(F.translate("text", "/", "|")).alias("text"), F.when(right, 30.0).otherwise(60.0 + rotation / 180).alias("confidence"))


over_txns(
    "page_orientation",
    lambda t: boxes.oriented(_pages(t), _read, enough=5).select("file_id", "page_no", "rotation", F.col("score").cast("double").alias("score")),
    TXN + f"SELECT 'account-' || account_id AS file_id, {PAGE_SQL} AS page_no, CASE WHEN account_id % 3 = 0 THEN 180 ELSE 0 END AS rotation, CAST(count(*) * 1000 + 30 AS DOUBLE) AS score FROM txn GROUP BY account_id, {PAGE_SQL}",
)

# --- tables by position, newest first -----------------------------------------------------------


def positioned_lines(t: DataFrame) -> DataFrame:
    """One page an account, newest first; amounts stand up to five units off their column, every ninth amount
    on a line of its own, every eighth balance is missing, every seventh narration goes on below."""
    item = lambda x, text: F.struct(F.lit(x).cast("double").alias("x") if isinstance(x, (int, float)) else x.cast("double").alias("x"), text.alias("text"))
    at = 4 * (F.lit(20_000_000) - F.col("seq"))
    off = F.col("seq") % 6
    money = item(F.when(F.col("debit") > 0, 430 + off).otherwise(520 + off), F.col("amount").cast("string"))
    held = item(600 - off, F.concat(F.abs("balance").cast("string"), F.lit("Cr")))
    alone = (F.col("seq") % 9 == 0) & (F.col("seq") % 8 != 0)
    start = F.array(item(30, F.date_format("txn_date", "dd-MM-yyyy")), item(160, F.lit("NO")), item(200, F.col("seq").cast("string")))
    items = F.concat(start, F.when(alone, F.array(held)).when(F.col("seq") % 8 == 0, F.array(money)).otherwise(F.array(money, held)))
    line = lambda n, its: F.struct(n.cast("int").alias("line_no"), its.alias("items"))
    heads = F.array(item(30, F.lit("TRAN DATE")), item(431, F.lit("WITHDRAWAL(DR)")), item(521, F.lit("DEPOSIT(CR)")), item(601, F.lit("BALANCE(INR)")))
    own = [line(at, items), F.when(alone, line(at + 1, F.array(money))), F.when(F.col("seq") % 7 == 0, line(at + 2, F.array(item(160, F.lit("AND MORE")))))]
    of = lambda rows, each: rows.select(file_id(), F.explode(F.array(*each)).alias("l")).filter("l IS NOT NULL").select("file_id", "l.line_no", "l.items")
    lines = put_together(of(t.select("account_id").distinct(), [line(F.lit(0), heads)]), of(t, own))
    return lines.select("file_id", F.lit(1).alias("page_no"), "line_no", F.array_join(F.transform("items", lambda i: i["text"]), " ").alias("text"), "items")


over_txns(
    "positioned_rows",
    lambda t: grid.newest_first(positioned_lines(t)).select("file_id", F.col("row_no").cast("long").alias("row_no"), F.date_format("txn_date", "yyyy-MM-dd").alias("day"), "particulars", dbl(F.col("withdrawal")).alias("withdrawal"), dbl(F.col("deposit")).alias("deposit"), dbl(F.col("balance")).alias("balance")),
    TXN + f""", p AS (SELECT account_id, seq, txn_date, debit, amount, CASE WHEN seq % 8 <> 0 THEN abs(balance) END AS held FROM txn),
q AS (SELECT *, held - lag(held) OVER (PARTITION BY account_id ORDER BY seq) AS change, row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) AS row_no FROM p)
SELECT 'account-' || account_id AS file_id, row_no, strftime(txn_date, '%Y-%m-%d') AS day, 'NO ' || seq || CASE WHEN seq % 7 = 0 THEN ' AND MORE' ELSE '' END AS particulars,
  {D('CASE WHEN change IS NULL THEN CASE WHEN debit > 0 THEN amount END WHEN change <= -0.02 THEN -change END')} AS withdrawal, {D('CASE WHEN change IS NULL THEN CASE WHEN debit = 0 THEN amount END WHEN change >= 0.02 THEN change END')} AS deposit, {D('held')} AS balance FROM q""",
    keep="account_id seq txn_date debit amount balance",
)

# --- a manual ledger against the computed one ---------------------------------------------------


def _ledgers(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Computed: each narration's sum.  Manual: the same names with a word before and one cut, every fifth left out."""
    own = t.groupBy("account_id", F.col("narration").alias("name")).agg(F.sum("amount").alias("amount"), F.min("seq").alias("id")).filter("name LIKE 'RENT%' OR name LIKE 'SALARY%' OR name LIKE 'CHQ PAID%'")
    manual = own.filter("id % 5 <> 0").select("account_id", (F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("M/S "), F.col("name"), F.lit(" & SONS")).alias("name"), "amount")
    return manual, own


over_txns(
    "manual_ledger_matched",
    lambda t: matching.assigned(*_ledgers(t)).select("account_id", "manual_id", "computed_id"),
    TXN + """, own AS (SELECT account_id, narration, min(seq) AS id FROM txn WHERE narration LIKE 'RENT%' OR narration LIKE 'SALARY%' OR narration LIKE 'CHQ PAID%' GROUP BY ALL)
SELECT account_id, id + 1000000 AS manual_id, id AS computed_id FROM own WHERE id % 5 <> 0""",
)

# --- the override log through time --------------------------------------------------------------

AGE = 10**9  # numbers of events of one time lie within


def _log(t: DataFrame) -> DataFrame:
    """The events of the override queries, numbered in the order of their time."""
    row = F.split_part("txn_id", F.lit("-"), F.lit(2)).cast("long")
    return _events(t).withColumn("seq", F.col("at") * AGE + row * 10 + F.when(F.col("action") == "assign", 1).otherwise(2))


def _asked(t: DataFrame) -> DataFrame:
    log = _log(t)
    twice = history.merged(log.filter("at <= 3"), log.filter("at >= 2"))
    asks = t.select("account_id").distinct().select("account_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 2, 3, 4, 5, 9)])).alias("ask_at"))
    return history.as_of(history.snapshots_at(log.filter("at <= 4"), [2, 4]), twice, asks)


OF_TIME = TXN + """, e AS (SELECT account_id, txn_id, 'assign' AS action, 'FIRST' AS party, 1 AS t FROM txn WHERE seq % 11 = 0 UNION ALL SELECT account_id, txn_id, 'exclude', NULL, 2 FROM txn WHERE seq % 22 = 0
  UNION ALL SELECT account_id, txn_id, 'restore', NULL, 3 FROM txn WHERE seq % 33 = 0 UNION ALL SELECT account_id, txn_id, 'assign', 'SECOND', 4 FROM txn WHERE seq % 44 = 0
  UNION ALL SELECT account_id, txn_id, 'reset', NULL, 5 FROM txn WHERE seq % 55 = 0 UNION ALL SELECT account_id, txn_id, 'exclude', NULL, 1 FROM txn WHERE seq % 13 = 0),
s AS (SELECT account_id, ask_at, txn_id, coalesce(max(t) FILTER (action = 'reset'), -1) AS r, max(t) FILTER (action = 'assign') AS a, max(t) FILTER (action = 'exclude') AS x,
  coalesce(max(t) FILTER (action IN ('restore', 'assign')), -1) AS l, arg_max(party, t) FILTER (action = 'assign') AS party FROM e, (SELECT unnest([0, 1, 2, 3, 4, 5, 9]) AS ask_at) WHERE t <= ask_at GROUP BY ALL)
SELECT account_id, CAST(ask_at AS BIGINT) AS ask_at, txn_id, CASE WHEN a > r THEN party END AS party, CASE WHEN x > r AND x > l THEN 'excluded' ELSE 'active' END AS status FROM s WHERE (x > r AND x > l) OR a > r"""
over_txns("overrides_as_of", _asked, OF_TIME, keep="account_id txn_id seq")
over_txns(
    "overrides_advanced",
    lambda t: history.settled(history.advanced(history.folded(_log(t).filter("at <= 2"), ["account_id"]).withColumn("upto", F.lit(3 * AGE - 1)), _log(t)), ["account_id"]),
    "SELECT account_id, txn_id, party, status FROM (" + OF_TIME + ") WHERE ask_at = 9",
    keep="account_id txn_id seq",
)
