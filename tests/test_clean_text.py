"""Headings and phrases: each pattern is tried only where its word occurs, with the results of trying all."""

from functools import reduce

from pyspark.sql import functions as F

from ledgerlake.functions import columns as c
from ledgerlake.functions import tables as t


def test_patterns_are_tried_by_their_word(spark):
    phrases = [p.replace(".*", "[^\\n]*") for p in t.PHRASES]
    assert all(c.own_word(p) for p in t.HEADINGS + phrases)
    texts = [
        None, "", "UPI-ALPHA", "x Statement Period : 2024-01-01 to 2024-02-01 y", "VALSTATEMENT PERIOD : 2024-01-01UE DA z", "Total Debit Total Credit Closing Balance 1,2 3", "opening balance total total closing balance 5",
        "a * closing balance includes funds earmarked b. c", "see www.x.in or 1800-12345678", "24 X 7 HELPLINE now", "DEAR  CUSTOMER read\nmore", "GL. SUB HEAD CODE 5", "toll-free x", "customer id: A1 cin no: Z9 ifsc code Q",
        "REGD OFFICE a REGD. OFFICE b", "VALUE DATE", "value da", "ß VALUE DA", "service outlet x", "transaction value date particulars cheque debit credit balance date no",
    ]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    every = lambda patterns, put: reduce(lambda x, p: c.without_first(x, p, put), patterns, F.col("x"))
    got = df.select(c.without_each(F.col("x"), t.HEADINGS, "").alias("h"), every(t.HEADINGS, "").alias("h0"), c.without_each(F.col("x"), phrases, " ").alias("p"), every(phrases, " ").alias("p0"))
    rows = got.collect()
    assert [(r["h"], r["p"]) for r in rows] == [(r["h0"], r["p0"]) for r in rows]
    assert sum(r["h"] != x for r, x in zip(rows, texts)) > 5
