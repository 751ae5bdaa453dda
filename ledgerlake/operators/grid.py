"""Tables by the position of their words: columns found by the density of x positions,
each amount put into the nearest column, rows put together from their lines.

Positions of amounts are counted per file and whole unit of x, so what is sorted to find
columns is one row per position that occurs, however long the file.  A column is a run of
positions without a gap; it takes the name of the nearest header, or its place from the
right (balance, deposit, withdrawal) where no header says so.  An amount looks at its file's
few columns in an array; no rows are multiplied.  What a line says is made once, before lines are numbered, so
that words with positions are never shuffled.

Rows are listed newest first: a date with an amount opens a row; a line that holds nothing but one
amount gives the row above it that amount; other lines go on with its words.  The step to the
next row's balance gives side and amount, the printed column only where that balance is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..sources.scratch import small, written
from .balances import with_neighbour
from .columnar import NO_WORDS, clean
from .prefix import once, running

GAP = 25
LEAST = 1
BUCKET = 1 << 14
AMOUNT = r"(?i)^-?[\d,]+\.\d{2}\s*(cr|dr)?$"
DATE = r"^\d{2}[./-]\d{2}[./-]\d{2,4}$"
NAMES = ("withdrawal", "deposit", "balance")


def words_of(lines: DataFrame) -> DataFrame:
    return lines.select("file_id", F.explode("items").alias("i")).select("file_id", F.col("i.x").alias("x"), clean(F.col("i.text")).alias("text"))


def amount_columns(lines: DataFrame, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """(file_id, column_no, x, n): where amounts stand, left to right; stray positions with fewer than
    ``least`` amounts are no column unless the file has nothing else."""
    at = words_of(lines).filter(F.col("text").rlike(AMOUNT)).groupBy("file_id", F.round("x").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    across = Window.partitionBy("file_id").orderBy("at")
    opens = F.when(F.coalesce(F.col("at") - F.lag("at").over(across) > gap, F.lit(True)), 1).otherwise(0)
    runs = at.withColumn("_o", opens).withColumn("_c", F.sum("_o").over(across))
    found = runs.groupBy("file_id", "_c").agg((F.sum(F.col("at") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy("file_id"))
    kept = found.withColumn("_m", most).filter((F.col("n") >= least) | (F.col("_m") < least))
    return kept.select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("x")).alias("column_no"), "x", "n")


def header_places(lines: DataFrame) -> DataFrame:
    """(file_id, name, x) of the first header of each amount column."""
    said = lines.select("file_id", "page_no", "line_no", F.explode("items").alias("i"))
    name = lambda text: F.coalesce(*[F.when(text.rlike(f"(?i){p}"), n) for n, p in t.AMOUNT_HEADERS.items()])
    any_name = "|".join(f"(?:{p})" for p in t.AMOUNT_HEADERS.values())
    heads = said.filter(clean(F.col("i.text")).rlike(f"(?i){any_name}")).withColumn("name", name(clean(F.col("i.text")))).filter("name IS NOT NULL")
    return heads.groupBy("file_id", "name").agg(F.min_by("i.x", F.struct("page_no", "line_no")).alias("x"))


def named_columns(lines: DataFrame, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """(file_id, columns): the columns of a file as an array of (x, name).  A column bears the name of a header
    if each is the nearest to the other; the rest are named from the right in the order of NAMES."""
    found, heads = amount_columns(lines, gap, least), header_places(lines)
    cols = found.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("x", "column_no"))).alias("cols"))
    head = heads.groupBy("file_id").agg(F.collect_list(F.struct("x", "name")).alias("heads"))
    both = cols.join(head, "file_id", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<struct<x:double,name:string>>")))
    nearest_head = lambda x: F.array_min(F.transform("heads", lambda h: F.struct(F.abs(h["x"] - x).alias("d"), h["name"].alias("name"), h["x"].alias("x"))))
    nearest_col = lambda x: F.array_min(F.transform("cols", lambda k: F.struct(F.abs(k["x"] - x).alias("d"), k["column_no"].alias("no"))))
    mutual = lambda k: F.when(nearest_col(nearest_head(k["x"])["x"])["no"] == k["column_no"], nearest_head(k["x"])["name"])
    said = F.transform("cols", lambda k: F.struct(k["x"].alias("x"), k["column_no"].alias("no"), mutual(k).alias("name")))
    both = both.withColumn("said", said)
    free = F.filter(F.array(*[F.lit(n) for n in reversed(NAMES)]), lambda n: ~F.exists("said", lambda s: F.coalesce(s["name"] == n, F.lit(False))))
    both = both.withColumn("free", free).withColumn("unnamed", F.reverse(F.filter("said", lambda s: s["name"].isNull())))
    given = lambda s: F.coalesce(s["name"], F.get("free", (F.array_position(F.transform("unnamed", lambda u: u["no"]), s["no"]) - 1).cast("int")), F.lit("other"))
    return both.select("file_id", F.transform("said", lambda s: F.struct(s["x"].alias("x"), given(s).alias("name"))).alias("columns"))


def nearest(x: Column) -> Column:
    """The name of the column nearest to x (columns: an array of (x, name))."""
    return F.array_min(F.transform("columns", lambda k: F.struct(F.abs(k["x"] - x).alias("d"), k["name"].alias("name"))))["name"]


def of_column(name: str) -> Column:
    return F.get(F.filter("columns", lambda k: k["name"] == name), F.lit(0))["x"]


def marked_items(items: Column) -> Column:
    """The words of a line, each with what it looks like."""
    cleaned = F.transform(items, lambda i: F.struct(i["x"].alias("x"), clean(i["text"]).alias("text")))
    return F.transform(cleaned, lambda i: F.struct(i["x"].alias("x"), i["text"].alias("text"), i["text"].rlike(AMOUNT).alias("money"), i["text"].rlike(DATE).alias("dated")))


def placed_rows(lines: DataFrame, words_from: float = 150.0, words_to: float = 430.0, noise: str = t.POSITION_NOISE, gap: int = GAP, least: int = LEAST) -> DataFrame:
    """(file_id, row_no, txn_date, particulars, balance, amount, side): rows as printed, newest first."""
    none = F.array().cast("array<struct<x:double,text:string>>")
    columns = named_columns(lines, gap, least).withColumn("_w", of_column("withdrawal")).withColumn("_b", of_column("balance"))
    near = small(columns, "position-columns")
    rows = lines.select("file_id", "page_no", "line_no", clean(F.col("text")).alias("text"), F.coalesce("items", none).alias("items"))
    rows = rows.filter((F.col("text") != "") & ~F.col("text").rlike(noise)).join(near, "file_id", "left")
    rows = once(rows.withColumnRenamed("items", "_items"), items=marked_items(F.col("_items"))).drop("_items")
    amounts = F.transform(F.filter("items", lambda i: i["money"]), lambda i: F.struct(i["x"].alias("x"), F.abs(c.amount_of_text(i["text"])).alias("value"), i["text"].rlike("(?i)cr$").alias("cr"), i["text"].alias("text")))
    rows = once(rows, amounts=amounts, day=c.parsed_date(F.get(F.filter("items", lambda i: i["dated"]), F.lit(0))["text"]))
    alone = (F.size("amounts") == 1) & (F.col("text") == F.get("amounts", F.lit(0))["text"])
    kind = F.when(alone, "orphan").when(F.col("day").isNull(), F.when(~F.col("text").rlike(AMOUNT), "words")).when(F.size("amounts") > 0, "row")
    rows = once(rows, kind=kind).filter("kind IS NOT NULL")
    width = F.coalesce(F.col("_w") - 10, F.lit(words_to))
    own = F.array_sort(F.filter("items", lambda i: ~i["money"] & ~i["dated"] & i["x"].between(F.lit(words_from), width)))
    own_words = F.array_join(F.transform(own, lambda i: i["text"]), " ")
    said = F.when(F.col("kind") == "row", own_words).when(F.col("kind") == "words", F.col("text"))
    by_balance = F.array_min(F.transform("amounts", lambda a, i: F.struct(F.coalesce(F.abs(a["x"] - F.col("_b")), F.lit(0.0)).alias("d"), i.alias("i"))))["i"]
    last_cr = F.array_max(F.transform("amounts", lambda a, i: F.when(a["cr"], i)))
    one, first = F.size("amounts") == 1, F.get("amounts", F.lit(0))
    rows = once(rows, said=said, _held=F.when(~one, F.coalesce(last_cr, by_balance)))
    # the amount that may be no balance: the only one, or beside the balance the first other one
    other = F.when(one, first).otherwise(F.get(F.filter("amounts", lambda a, i: i != F.col("_held")), F.lit(0)))
    rows = once(once(rows, _other=other), _name=nearest(F.col("_other.x")))
    at_balance = first["cr"] | (F.col("_name") == "balance")
    balance = F.when(one, F.when(at_balance, first["value"])).otherwise(F.get("amounts", F.col("_held"))["value"])
    moved = F.struct(F.col("_other.value").alias("value"), F.col("_name").alias("name"))
    is_row, is_orphan = F.col("kind") == "row", F.col("kind") == "orphan"
    rows = rows.select(
        "file_id", "page_no", "line_no", "kind", F.when(is_row, F.col("day")).alias("day"), F.when(F.length("said") > 0, F.col("said")).alias("said"),
        F.when(is_row, balance).alias("balance"), F.when(is_orphan | (is_row & ~(one & at_balance)), moved).alias("moved"),
    )
    rows = written(rows, "position-rows")
    bucket = F.struct("page_no", F.floor(F.col("line_no") / BUCKET).alias("part"))
    rows = running(rows, ["file_id"], bucket, ["page_no", "line_no"], "n", {"row_no": F.when(is_row, 1).otherwise(0)})
    rows = written(rows.withColumn("row_no", F.col("row_no").cast("long")).filter("row_no > 0").drop("page_no", "line_no"), "position-numbered")
    below = rows.filter(~is_row & (is_orphan | F.col("said").isNotNull())).groupBy("file_id", "row_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("n", "said")))).alias("more"),
        F.max_by("moved", F.when(is_orphan, F.col("n"))).alias("late"),
    )
    put = rows.filter(is_row).select("file_id", "row_no", "day", "said", "balance", "moved").alias("r")
    put = put.join(below.alias("m"), F.col("r.file_id").eqNullSafe(F.col("m.file_id")) & (F.col("r.row_no") == F.col("m.row_no")), "left")
    full = F.concat_ws(" ", "said", F.transform("more", lambda w: w["said"]))
    put = once(put.select("r.file_id", "r.row_no", "day", "balance", "said", "more", F.coalesce("late", "moved").alias("moved")), cut=full)
    cut = F.col("cut")
    for pattern in t.POSITION_TAILS:
        cut = F.regexp_replace(cut, pattern, "")
    words = F.coalesce(F.nullif(F.trim(cut), F.lit("")), F.lit(NO_WORDS))
    return put.select("file_id", "row_no", F.col("day").alias("txn_date"), words.alias("particulars"), "balance", F.col("moved.value").alias("amount"), F.col("moved.name").alias("side"))


def newest_first(lines: DataFrame, step: float = 0.02, **places) -> DataFrame:
    """(file_id, row_no, txn_date, particulars, withdrawal, deposit, balance)."""
    rows = written(placed_rows(lines, **places).withColumn("seq", F.col("row_no")), "position-put")
    near = with_neighbour(rows, ("file_id",), True, "_older")
    change = (F.col("balance") - F.col("_older")).cast("decimal(18,2)")
    printed = F.col("amount").isNotNull()
    out = F.when(F.col("side") == "withdrawal", F.col("amount"))
    into = F.when(printed & (F.col("side") != "withdrawal"), F.col("amount"))
    small = F.abs(change) < step
    withdrawal = F.when(change.isNull(), out).when(~small & (change < 0), -change)
    deposit = F.when(change.isNull(), into).when(~small & (change > 0), change)
    return near.select("file_id", "row_no", "txn_date", "particulars", withdrawal.alias("withdrawal"), deposit.alias("deposit"), "balance")
