"""Line tables to transactions.  Lines stream through a task in the order of their file, and a file's
lines are spooled, not held; account labels and printed totals take a file as one group."""

from __future__ import annotations

import json
import math
import tempfile
from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout

SPOOL_BYTES = 16 << 20
ROW_BATCH = 10_000
ROWS = "file_id string, layout string, row_no int, txn_date date, particulars string, cheque_no string, withdrawal double, deposit double, balance double"


def grouped_lines(xs: list[float], ys: list[float], texts: list[str], gap: float) -> list[tuple[float, list[tuple[float, str]]]]:
    """(mean height, words) of each line, down the page.  Lines are kept in cells of their mean height, two gaps
    high, so a word looks at three cells and not at all lines."""
    high = 2 * gap or 1.0
    means: list[float] = []
    words: list[list[tuple[float, str]]] = []
    cells: dict[int, set[int]] = {}
    for x, y, text in zip(xs, ys, texts):
        finite = y is not None and math.isfinite(y)
        at = math.floor(y / high) if finite else None
        home = min((k for c in (at - 1, at, at + 1) for k in cells.get(c, ()) if abs(means[k] - y) <= gap), default=None) if finite else None
        if home is None:
            means.append(y)
            words.append([(x, text)])
            if finite:
                cells.setdefault(at, set()).add(len(means) - 1)
            continue
        n, was = len(words[home]), math.floor(means[home] / high)
        means[home] = (means[home] * n + y) / (n + 1)
        words[home].append((x, text))
        now = math.floor(means[home] / high)
        if now != was:
            cells[was].remove(home)
            cells.setdefault(now, set()).add(home)
    order = sorted(range(len(means)), key=lambda k: -means[k])
    return [(means[k], sorted(words[k])) for k in order]


def cluster_items(items: DataFrame, gap: float = 3.0) -> DataFrame:
    """Positioned words (file_id, page_no, item_no, x, y, text) to lines: a word
    joins the first line within the gap of its mean height; lines go down the
    page, words from left to right."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_no")
        lines = grouped_lines(pdf["x"].tolist(), pdf["y"].tolist(), pdf["text"].tolist(), gap)
        made = [(pdf["file_id"].iloc[0], pdf["page_no"].iloc[0], k, y, its) for k, (y, its) in enumerate(lines)]
        return pd.DataFrame(
            [(f, p, k, y, " ".join(s for _, s in its), [{"x": x, "text": s} for x, s in its]) for f, p, k, y, its in made],
            columns=["file_id", "page_no", "line_no", "y", "text", "items"],
        )

    schema = "file_id string, page_no int, line_no int, y double, text string, items array<struct<x:double,text:string>>"
    return items.groupBy("file_id", "page_no").applyInPandas(run, schema)


def in_order(pdf: pd.DataFrame) -> list[tuple[str, list[tuple[float, str]]]]:
    pdf = pdf.sort_values(["page_no", "line_no"])
    return [(t or "", [(i["x"], i["text"]) for i in its] if its is not None else []) for t, its in zip(pdf["text"], pdf["items"])]


def words_of(items: str | None) -> list[tuple[float | None, str | None]]:
    """The placed words of a line from JSON (numbers that are none come as texts)."""
    return [(float(i["x"]) if i.get("x") is not None else None, i.get("text")) for i in json.loads(items)] if items else []


class Spool:
    """A file's lines, to be read several times over: in memory while they are few, else in a temporary file."""

    def __init__(self, file_id: object):
        self.file_id = file_id
        self.marks = layout.Marks()
        self.store = tempfile.SpooledTemporaryFile(SPOOL_BYTES)
        self.writer: pa.RecordBatchStreamWriter | None = None

    def add(self, texts: pa.Array, items: pa.Array) -> None:
        shown = [layout.squeezed(x) for x in texts.to_pylist()]
        for x in shown:
            self.marks.add(x)
        batch = pa.RecordBatch.from_arrays([pa.array(shown, pa.large_string()), items], ["text", "items"])
        self.writer = self.writer or pa.ipc.new_stream(self.store, batch.schema)
        self.writer.write_batch(batch)

    def __iter__(self) -> Iterator[tuple[str, list[tuple[float, str]]]]:
        self.store.seek(0)
        for batch in pa.ipc.open_stream(self.store):
            texts, items = batch.column(0).to_pylist(), batch.column(1)
            if items.null_count == len(items):
                yield from ((x, []) for x in texts)
            else:
                yield from ((x, words_of(its)) for x, its in zip(texts, items.to_pylist()))

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.writer.close()
        name, rows = layout.statement_rows(self, self.marks)
        made = ((self.file_id, name, k, r.date, r.particulars, r.cheque_no, r.withdrawal, r.deposit, r.balance) for k, r in enumerate(rows))
        for part in batched(made, ROW_BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), ROW_TYPES)], [c.split()[0] for c in ROWS.split(", ")])
        self.store.close()


ROW_TYPES = [pa.string(), pa.string(), pa.int32(), pa.date32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Transactions of every file, with the layout they were read by.

    The number of a line puts the lines in order; where they lie by file already it moves none.  Placed words go as JSON:
    a batch asks for its size after each row, and a column of arrays answers by going through the whole batch."""
    last = lambda name: F.col(name).asc_nulls_last()
    number = F.row_number().over(Window.partitionBy("file_id").orderBy(last("page_no"), last("line_no")))
    ordered = lines.select("file_id", "text", F.to_json("items").alias("items"), number.alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spool: Spool | None = None
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            begin = 0
            for end, file_id in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if spool is None or spool.file_id != file_id:
                    if spool:
                        yield from spool.rows()
                    spool = Spool(file_id)
                spool.add(batch.column(1).slice(begin, end - begin), batch.column(2).slice(begin, end - begin))
                begin = end
        if spool:
            yield from spool.rows()

    return ordered.mapInArrow(run, ROWS)


def account_info(lines: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = layout.account_info([t for t, _ in in_order(pdf)])
        return pd.DataFrame([(pdf["file_id"].iloc[0], k, a, b) for k, (a, b) in enumerate(found)], columns=["file_id", "ord", "label", "value"])

    return lines.select("file_id", "page_no", "line_no", "text", "items").groupBy("file_id").applyInPandas(run, "file_id string, ord int, label string, value string")


def printed_totals(lines: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, d, c = layout.printed_totals([t for t, _ in in_order(pdf)])
        return pd.DataFrame([(pdf["file_id"].iloc[0], w, d, c)], columns=["file_id", "withdrawal", "deposit", "closing_balance"])

    schema = "file_id string, withdrawal double, deposit double, closing_balance double"
    return lines.select("file_id", "page_no", "line_no", "text", "items").groupBy("file_id").applyInPandas(run, schema)
