"""Statements are read as streams: long ones cost no more memory or time a line than short ones."""

import time
import tracemalloc

import pytest

from ledgerlake.functions import layout
from ledgerlake.operators import parsing


class Told:
    """Lines made anew for each reading, none held."""

    def __init__(self, n, kind):
        self.n, self.kind = n, kind

    def __iter__(self):
        if self.kind == "split":
            yield from [("DCB Bank", []), ("Opening Balance 0.00", [])]
        for k in range(1, self.n + 1):
            one = ["05/03/2024", f"UPI-ALPHA-{k}@ybl", f"10.00 {10 * k}.00"]
            yield from ((x, []) for x in (one if self.kind == "split" else [" ".join(one)]))


@pytest.mark.parametrize("kind", ["split", "generic"])
def test_rows_come_one_by_one(kind):
    lines = Told(20_000, kind)
    tracemalloc.start()
    name, rows = layout.statement_rows(lines, layout.marks_of(lines))
    n = sum(r.deposit == 10.0 for r in rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (name, n) == (kind, 20_000)
    assert peak < 4 << 20


def test_noise_is_the_same_by_first_letter():
    every = layout.either(layout.t.NOISE_LINES + layout.TERMINALS + layout.HEADERS)
    texts = ["page 3", "PAGE TOTAL", "-----", "123", "3 of 4", "Grand Total: 5", "SI - X", "si -x", "address x", "A/C Number : 1", "legends x", "+++ end of statement", "", "é", "Kpage", "UPI-ALPHA", "closing balance 5", "team icici bank"]
    texts += [p.strip("^$").replace(r"\s+", " ").replace(r"\b", "").replace("\\", "") for p in layout.t.NOISE_LINES]
    assert [bool(layout.IGNORED.search(x)) for x in texts] == [bool(every.search(x)) for x in texts]
    assert sum(bool(every.search(x)) for x in texts) > 60


def test_prefixed_rows_look_ahead_in_time_of_their_length():
    lines = [("Tran Date Chq No Particulars Debit Credit Balance", [])]
    for k in range(20_000):
        lines += [(f"UPI/ALPHA/{k}", []), ("01/04/2024 10.00 90.00", [])]
    began = time.monotonic()
    assert len(layout.parse_generic(lines)) == 20_000
    assert time.monotonic() - began < 8


def test_spooled_files(spark, monkeypatch):
    monkeypatch.setattr(parsing, "SPOOL_BYTES", 1000)
    rows = [(f, 1, k, x, i) for f in ("a", "b", None) for k, (x, i) in enumerate(Told(3000, "split" if f == "a" else "generic"))]
    lines = spark.createDataFrame(rows, "file_id string, page_no int, line_no int, text string, items array<struct<x:double,text:string>>")
    got = parsing.parse_lines(lines).groupBy("file_id", "layout").agg({"row_no": "max", "balance": "max"}).collect()
    assert {(r["file_id"], r["layout"], r["max(row_no)"], r["max(balance)"]) for r in got} == {("a", "split", 2999, 30000.0), ("b", "generic", 2999, 30000.0), (None, "generic", 2999, 30000.0)}
