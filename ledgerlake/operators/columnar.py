"""Scanned tables read column by column: each page of a file gives a block of dates, one
of descriptions and one of balances, and the blocks have unequal lengths.

A change between balances is a transaction.  Sections and pages come from running
counts over the headers alone (operators.prefix); the entries of a page meet in one task.  The balance before a page's first one is that of the page before, from the
first page on that has a transaction.

Which description belongs to which change can be told in two ways:

* ``by_number``: the k-th to the k-th, as the columns are printed;
* ``aligned``: a scan loses descriptions and breaks others in two, and from there on
  numbers are off by one.  The two ordered lists of a page are aligned by dynamic
  programming: a pair costs nothing if the words agree with the sign of the
  change, UNKNOWN_COST if they tell nothing, CONFLICT_COST if they contradict it,
  and leaving out either side costs GAP_COST.  Of equal alignments the one that pairs early wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import tables as t
from ..sources.scratch import small, written
from .prefix import once, running

BUCKET_LINES = 1 << 14
NO_WORDS = "TRANSACTION"
WORDS_IN = re.compile(r"^BY\b|\b(CR|CREDIT|DEPOSIT|CHQ RETURN|INWARD RETURN)\b")
WORDS_OUT = re.compile(r"^TO\b|\b(DR|DEBIT|WITHDRAWAL|CHARGES?|CHQ PAID)\b|^GST$")
UNKNOWN_COST, CONFLICT_COST, GAP_COST = 1, 6, 2
SLACK = 64  # cells beside the diagonals that are looked at first
FAR = 1 << 29


def clean(text: Column) -> Column:
    """White space as single blanks; a text that has no other is not rebuilt."""
    given = F.coalesce(text, F.lit(""))
    return F.trim(F.when(given.rlike(r"[\t-\r\u00a0]| {2}"), F.regexp_replace(given, r"[\s\u00a0]+", " ")).otherwise(given))


def header_of(text: Column) -> Column:
    """The column that a line heads, else null; most lines meet one pattern only."""
    named = lambda x: F.coalesce(*[F.when(x.rlike(f"(?i){pattern}"), name) for name, pattern in t.COLUMN_HEADERS.items()])
    return F.when(text.rlike(f"(?i){'|'.join(t.COLUMN_HEADERS.values())}"), c.bound(text, named))


def headed(rows: DataFrame) -> DataFrame:
    """(file_id, page_no, part, heads): for each part of a page of paper, which is BUCKET_LINES lines, the headers in it in order, and
    before them the last one above, each as (at, page, column, first).  A page begins with every TRANS DATE header but the first;
    first tells the first header of its column on its page."""
    found = rows.groupBy("file_id", "page_no", "part", F.when(F.col("head").isNotNull(), F.col("line_no")).alias("line_no"), "head").agg(F.count(F.lit(1)).alias("_n"))
    found = written(found.drop("_n"), "column-heads")
    heads = found.filter("head IS NOT NULL")
    heads = running(heads, ["file_id"], F.col("page_no"), ["line_no"], "section", {"page": F.when(F.col("head") == "trans_date", 1).otherwise(0)})
    heads = heads.withColumn("page", F.greatest(F.col("page").cast("int"), F.lit(1)))
    first = F.row_number().over(Window.partitionBy("file_id", "page", "head").orderBy("section")) == 1
    heads = heads.select("file_id", "page_no", "part", F.struct(F.col("section").alias("no"), line_at().alias("at"), "page", F.col("head").alias("column"), first.alias("first")).alias("h"))
    last = heads.groupBy("file_id", "page_no", "part").agg(F.array_sort(F.collect_list("h")).alias("heads"))
    parts = found.select("file_id", "page_no", "part").distinct().alias("p")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ("file_id", "page_no", "part")]
    both = parts.join(last.alias("l"), same, "left").select("p.*", "l.heads")
    above = F.last(F.element_at("heads", -1), ignorenulls=True).over(Window.partitionBy("file_id").orderBy("page_no", "part").rowsBetween(Window.unboundedPreceding, -1))
    carried = above.withField("at", F.lit(-(1 << 62)))
    both = both.withColumn("_above", carried)
    return both.select("file_id", "page_no", "part", F.array_compact(F.concat(F.array("_above"), F.coalesce("heads", F.array().cast(both.schema["heads"].dataType)))).alias("heads"))


def line_at() -> Column:
    return F.coalesce(F.col("line_no").cast("long"), F.lit(-(1 << 61)))


def sections(lines: DataFrame) -> DataFrame:
    """(file_id, page, column, page_no, at, text): the lines below the first header of each column of each page.

    Headers are few: they are found first, and each line looks at those of its part of the page, so lines are not shuffled."""
    rows = lines.select("file_id", "page_no", "line_no", clean(F.col("text")).alias("text"), F.floor(F.col("line_no") / BUCKET_LINES).alias("part"))
    near = small(headed(rows.withColumn("head", header_of(F.col("text")))), "column-parts")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}")) for k in ("file_id", "page_no", "part")]
    placed = rows.alias("r").join(near.alias("h"), same).select("r.file_id", "r.page_no", line_at().alias("at"), "r.text", "h.heads")
    under = F.slice(F.filter("heads", lambda h: h["at"] <= F.col("at")), -1, 1)
    placed = placed.select("file_id", "page_no", "at", "text", F.explode(under).alias("h")).filter("h.first")
    return placed.filter(header_of(F.col("text")).isNull()).select("file_id", "h.page", "h.column", "page_no", "at", "text")


def cents(amount: Column) -> Column:
    return (amount * 100).cast("long")


def entries(parts: DataFrame, most: float, trail: tuple[float, float] | None, starts: Sequence[str], skip: Sequence[str]) -> DataFrame:
    """(file_id, page, page_no, at, kind, text, opens, day, balance): what the columns of a page hold.  kind tells a date of the date
    column (0) or of the reference column (1), a line of a description (2), which may open one, a balance in cents (3).

    Numbers of ``most`` and above are no balances.  With trail = (low, high) a page's balances begin
    at the first one within these bounds that is no whole number, if that is not the first number at all."""
    column, text = F.col("column"), F.col("text")
    kind = F.when(column == "trans_date", 0).when(column == "reff", 1).when(column == "description", 2).when(column == "balance", 3)
    rows = parts.withColumn("kind", kind).filter("kind IS NOT NULL")
    rows = once(
        rows.select("file_id", "page", "page_no", "at", "kind", text.alias("line")),
        text=F.when(F.col("kind") == 2, F.col("line")), opens=F.when(F.col("kind") == 2, F.col("line").rlike(f"(?i)^({'|'.join(starts)})")),
        day=F.when(F.col("kind") < 2, c.parsed_date(F.col("line"))), balance=F.when(F.col("kind") == 3, c.amount_of_text(F.col("line"))),
    ).drop("line")
    said = (text != "") & ~text.rlike(f"(?i){'|'.join(skip)}")
    held = F.abs("balance") < most
    if trail is not None:
        low, high = trail
        page, place = Window.partitionBy("file_id", "page"), F.struct("page_no", "at")
        fits = F.col("balance").between(low, high) & (F.col("balance") != F.floor("balance"))
        rows = rows.withColumn("_p", place).withColumn("_0", F.min(F.when(F.col("balance").isNotNull(), place)).over(page)).withColumn("_1", F.min(F.when(fits, place)).over(page))
        held = F.when(F.coalesce(F.col("_1") > F.col("_0"), F.lit(False)), (F.col("_p") >= F.col("_1")) & (F.abs("balance") <= high)).otherwise(held)
    keep = F.when(F.col("kind") < 2, F.col("day").isNotNull()).when(F.col("kind") == 2, said).otherwise(held)
    return rows.withColumn("_keep", keep).filter("_keep").select("file_id", "page", "page_no", "at", "kind", "text", "opens", "day", cents(F.col("balance")).alias("balance"))


def carried(rows: DataFrame, least: float) -> DataFrame:
    """(file_id, page, before): the balance before a page's first one, from the first page on that has a transaction."""
    held, place = rows.filter("kind = 3").select("file_id", "page", "page_no", "at", "balance"), F.struct("page_no", "at")
    if least > 0.01:
        own = F.lag("balance").over(Window.partitionBy("file_id", "page").orderBy("page_no", "at"))
        moved = F.max(F.coalesce(F.abs(F.col("balance") - F.col("_own")) / 100 >= least, F.lit(False)))
        pages = held.withColumn("_own", own).groupBy("file_id", "page").agg(F.max_by("balance", place).alias("last"), moved.alias("moved"))
    else:  # no step is smaller than a cent
        pages = held.groupBy("file_id", "page").agg(F.max_by("balance", place).alias("last"), (F.max("balance") > F.min("balance")).alias("moved"))
    above = Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.coalesce(F.max("moved").over(above), F.lit(False)), F.last("last").over(above))
    return pages.select("file_id", "page", before.alias("before")).filter("before IS NOT NULL")


def sign_told(text: str) -> int:
    """1 if the words tell money in, -1 if they tell money out, else 0."""
    into, out = WORDS_IN.search(text.upper()), WORDS_OUT.search(text.upper())
    return 0 if bool(into) == bool(out) else 1 if into else -1


class Band:
    """Costs of the best alignments of what is left, for cells within ``slack`` of the diagonals from corner to corner.

    A row of the table is a few array steps; rows are kept at distances of the root of their number, and
    those between are made again on the way back, so memory grows with the width of the band only."""

    def __init__(self, signs: Sequence[int], told: Sequence[int], slack: int):
        self.signs, self.n, self.m = signs, len(signs), len(told)
        apart = self.n - self.m
        self.left, self.right = max(0, apart) + slack, slack - min(0, apart)
        said = np.asarray(told, dtype=np.int32)
        pair = lambda s: np.append(np.where(said == 0, UNKNOWN_COST, np.where(said == s, 0, CONFLICT_COST)), FAR).astype(np.int32)
        self.pairs = {s: pair(s) for s in set(signs)}
        self.ramp = GAP_COST * np.arange(self.left + self.right + 2, dtype=np.int32)
        self.stride = max(1, math.isqrt(self.n))
        lo, hi = self.bounds(self.n)
        row = (lo, GAP_COST * (self.m - np.arange(lo, hi + 1, dtype=np.int32)))
        self.kept = {self.n: row}
        for i in range(self.n - 1, -1, -1):
            row = self.above(i, row)
            if i % self.stride == 0:
                self.kept[i] = row
        self.least = int(row[1][0])

    def bounds(self, i: int) -> tuple[int, int]:
        return max(0, i - self.left), min(self.m, i + self.right)

    def above(self, i: int, below: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        lo, hi = self.bounds(i)
        after = np.full(hi - lo + 2, FAR, dtype=np.int32)
        after[below[0] - lo : below[0] - lo + len(below[1])] = below[1]
        ramp = self.ramp[: hi - lo + 1]
        own = np.minimum(after[1:] + self.pairs[self.signs[i]][lo : hi + 1], after[:-1] + GAP_COST)
        return lo, np.minimum.accumulate((own + ramp)[::-1])[::-1] - ramp

    def path(self) -> list[int | None]:
        out: list[int | None] = []
        j = 0
        for start in range(0, self.n, self.stride):
            end = min(start + self.stride, self.n)
            rows = {end: self.kept[end]}
            for i in range(end - 1, start - 1, -1):
                rows[i] = self.above(i, rows[i + 1])
            for i in range(start, end):
                (lo, here), (lo2, below) = rows[i], rows[i + 1]
                pair = self.pairs[self.signs[i]]
                while True:
                    cost = here[j - lo]
                    if j < self.m and 0 <= j + 1 - lo2 < len(below) and cost == below[j + 1 - lo2] + pair[j]:
                        out.append(j)
                        j += 1
                        break
                    if j < self.m and j + 1 - lo < len(here) and cost == here[j + 1 - lo] + GAP_COST:
                        j += 1
                        continue
                    out.append(None)
                    break
        return out


def earliest(signs: Sequence[int], told: Sequence[int]) -> list[int | None] | None:
    """Each description with the first change that is left and does not contradict it; none if one finds no change."""
    out: list[int | None] = [None] * len(signs)
    j, m = 0, len(told)
    for i, sign in enumerate(signs):
        if j == m:
            break
        if told[j] == 0 or told[j] == sign:
            out[i] = j
            j += 1
    return out if j == m else None


def align(signs: Sequence[int], told: Sequence[int]) -> list[int | None]:
    """For each change the number of its description, or none.

    Where descriptions are only lost, each one left finds a change that does not contradict it: then no alignment costs
    less than the one that pairs each as early as it can, and that is the one told for.  Else, an alignment that
    leaves the band costs more gaps than its width; where the best one within costs less, all best ones are within.
    Otherwise the band is made wide enough for the cost that was found."""
    if (early := earliest(signs, told)) is not None:
        return early
    n, m, slack = len(signs), len(told), SLACK
    while True:
        band = Band(signs, told, slack)
        if n == 0 or band.least < GAP_COST * (abs(n - m) + 2 * (slack + 1)) or slack >= max(n, m):
            return band.path()
        slack = min(max(n, m), band.least // (2 * GAP_COST) + 1)


PAGE_ROWS = "file_id string, page int, k int, txn_date date, particulars string, change long, balance long"


def page_rows(by: str, least: float) -> Callable[[pa.Table], pa.Table]:
    """The transactions of one page (entries with before): its rows are columns of numbers and texts throughout, none is an object."""

    def run(page: pa.Table) -> pa.Table:
        page = page.combine_chunks().sort_by([("kind", "ascending"), ("page_no", "ascending"), ("at", "ascending")])
        kind = page["kind"].to_numpy()
        first, last = np.searchsorted(kind, [0, 2, 3], "left"), np.searchsorted(kind, [1, 2, 3], "right")
        part = lambda i, name: page[name].slice(first[i], last[i] - first[i])
        days, texts, opens, held = part(0, "day"), part(1, "text"), part(1, "opens"), part(2, "balance").to_numpy()
        before = page["before"][0].as_py()
        steps = np.diff(held, prepend=held[:1] if before is None else before) if len(held) else held
        moved = np.flatnonzero((np.abs(steps) / 100 >= least) & ((np.arange(len(held)) > 0) | (before is not None)))
        if not len(days):
            moved = moved[:0]
        change, n = steps[moved], len(moved)
        begin = np.flatnonzero(opens.to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
        begin = begin if not len(texts) or (len(begin) and begin[0] == 0) else np.concatenate(([0], begin))
        words = texts.combine_chunks() if len(texts) else pa.array([], pa.string())
        if len(begin) < len(texts):
            words = pc.binary_join(pa.ListArray.from_arrays(np.append(begin, len(texts)).astype(np.int32), words.cast(pa.string())), " ")
        if by == "aligned" and n and len(words):
            at = pa.array(align(np.sign(change).tolist(), [sign_told(w) for w in words.to_pylist()]), pa.int64())
        else:
            at = pa.array([k if k < len(words) else None for k in range(n)], pa.int64())
        said = words.take(at).cast(pa.string())
        said = pc.if_else(pc.equal(pc.fill_null(said, ""), ""), NO_WORDS, said)
        dated = days.take(pa.array(np.minimum(np.arange(n), len(days) - 1), pa.int64())) if n else pa.array([], pa.date32())
        keys = [page[name].slice(0, 1).take(pa.array(np.zeros(n, np.int64))) for name in ("file_id", "page")]
        made = [*keys, pa.array(np.arange(1, n + 1), pa.int32()), dated, said, pa.array(change, pa.int64()), pa.array(held[moved], pa.int64())]
        return pa.table(made, names=[x.split()[0] for x in PAGE_ROWS.split(", ")])

    return run


def transactions(
    lines: DataFrame, by: str = "aligned", most: float = 1e7, trail: tuple[float, float] | None = None, least: float = 0.01,
    starts: Sequence[str] = t.NARRATION_STARTS, skip: Sequence[str] = t.NARRATION_SKIPS,
) -> DataFrame:
    """(file_id, page, k, txn_date, particulars, withdrawal, deposit, balance); the k-th change takes the
    page's k-th date, the last one for all beyond; changes of a page without dates are left out.

    The entries of a page meet in one shuffle."""
    rows = entries(sections(lines), most, trail, starts, skip)
    near = small(carried(rows, least), "column-before")
    same = [F.col("r.file_id").eqNullSafe(F.col("b.file_id")), F.col("r.page") == F.col("b.page")]
    full = rows.alias("r").join(near.alias("b"), same, "left").select("r.*", "b.before")
    found = full.groupBy("file_id", "page").applyInArrow(page_rows(by, least), PAGE_ROWS.replace("file_id string", f"file_id {lines.schema['file_id'].dataType.simpleString()}"))
    money = lambda x: (F.col(x).cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    return found.select(
        "file_id", "page", "k", "txn_date", "particulars", F.when(F.col("change") < 0, -money("change")).cast("decimal(18,2)").alias("withdrawal"),
        F.when(F.col("change") > 0, money("change")).alias("deposit"), money("balance").alias("balance"),
    )


def printed_totals(lines: DataFrame) -> DataFrame:
    """(file_id, withdrawal, deposit, closing_balance) as printed with their labels; a figure may stand
    on the line below its label.  Files that print no side are left out."""
    rows = lines.select("file_id", "page_no", "line_no", clean(F.col("text")).alias("text"))
    below = Window.partitionBy("file_id").orderBy("page_no", "line_no")
    rows = rows.withColumn("both", F.concat_ws(" ", "text", F.lead("text").over(below)))
    place = F.struct("page_no", "line_no")
    found = []
    for name, label in t.COLUMNAR_TOTALS.items():
        raw = F.when(F.col("text").rlike(f"(?i){label}"), F.nullif(F.regexp_extract("both", rf"(?i){label}\s+([\d,]+\.\d{{2}})", 1), F.lit("")))
        found.append(F.min_by(c.amount_of_text(raw), F.when(raw.isNotNull(), place)).cast("double").alias(name))
    return rows.groupBy("file_id").agg(*found).filter("withdrawal IS NOT NULL OR deposit IS NOT NULL")
