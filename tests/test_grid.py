"""Columns by position and rows put together from lines."""

from datetime import date

from ledgerlake.operators import grid

ITEMS = "file_id string, page_no int, line_no int, text string, items array<struct<x:double,text:string>>"


def line(k, *items):
    return ("f", 1, k, " ".join(s for _, s in items), [(float(x), s) for x, s in items])


def test_newest_first_rows(spark):
    rows = [
        line(0, (30, "TRAN DATE"), (90, "VALUE DATE"), (160, "NARRATION"), (431, "WITHDRAWAL(DR)"), (521, "DEPOSIT(CR)"), (601, "BALANCE(INR)")),
        line(1, (30, "05-01-2024"), (160, "NEFT TO"), (230, "SHOP"), (436, "100.00"), (603, "900.00Cr")),
        line(2, (160, "MORE WORDS page 1")),
        line(3, (30, "04-01-2024"), (160, "SALARY"), (600, "1,000.00Cr")),
        line(4, (524, "250.00")),
        line(5, (30, "page 1 of 3")),
        line(6, (30, "03-01-2024"), (160, "OPENING"), (520, "750.00"), (598, "750.00Cr")),
        line(7, (430, "1.00")),
        line(8, (520, "40.00")),
    ]
    df = spark.createDataFrame(rows, ITEMS)
    cols = grid.named_columns(df).first()["columns"]
    assert [c["name"] for c in cols] == ["withdrawal", "deposit", "balance"]
    got = grid.newest_first(df.filter("line_no < 7")).orderBy("row_no").collect()
    f = lambda x: None if x is None else float(x)
    assert [(r["txn_date"], r["particulars"], f(r["withdrawal"]), f(r["deposit"]), f(r["balance"])) for r in got] == [
        (date(2024, 1, 5), "NEFT TO SHOP MORE WORDS page 1", 100.0, None, 900.0),
        (date(2024, 1, 4), "SALARY", None, 250.0, 1000.0),
        (date(2024, 1, 3), "OPENING", None, 750.0, 750.0),
    ]
    last = grid.placed_rows(df).filter("row_no = 3").first()
    assert (float(last["amount"]), last["side"]) == (40.0, "deposit")  # the last amount that stands alone
    assert grid.newest_first(df.limit(0)).count() == 0


def test_columns_without_headers(spark):
    rows = [line(k, (10, "01-01-2024"), (300 + k % 4, "5.00"), (400 - k % 7, "6.00"), (500, "7.00Cr"), (50 + 40 * k, "words")) for k in range(20)] + [line(30, (700, "1.00"))]
    df = spark.createDataFrame(rows, ITEMS)
    found = grid.amount_columns(df, least=3).orderBy("x").collect()
    assert [(r["column_no"], round(r["x"]), r["n"]) for r in found] == [(1, 302, 20), (2, 397, 20), (3, 500, 20)]
    assert [c["name"] for c in grid.named_columns(df, least=3).first()["columns"]] == ["withdrawal", "deposit", "balance"]


def test_lines_are_numbered_without_their_words(spark, monkeypatch):
    seen = {}
    real = grid.written
    monkeypatch.setattr(grid, "written", lambda df, name: (seen.__setitem__(name, df.schema), real(df, name))[1])
    rows = [line(0, (431, "WITHDRAWAL(DR)"), (521, "DEPOSIT(CR)"), (601, "BALANCE(INR)"))]
    rows += [line(3 * k + 1, (30, "05-01-2024"), (160, f"NO {k}"), (520, f"{k + 1}.00"), (601, f"{900 - k * k}.00")) for k in range(40)]
    rows += [line(3 * k + 2, (160, "AND MORE")) for k in range(0, 40, 7)] + [line(3 * k + 3, (431, "7.00")) for k in range(0, 40, 9)]
    got = grid.newest_first(spark.createDataFrame(rows, ITEMS).repartition(3)).orderBy("row_no").collect()
    assert len(got) == 40 and all(r["particulars"] == f"NO {k}" + (" AND MORE" if k % 7 == 0 else "") for k, r in enumerate(got))
    assert [float(r["deposit"] or 0) for r in got[:3]] == [1.0, 3.0, 5.0] and float(got[39]["deposit"]) == 40.0
    assert "array" not in seen["position-rows"].simpleString()
