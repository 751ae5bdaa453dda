"""Placed words reach the parser whole, in no column of arrays, and lines that lie by file are not moved."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators import parsing


def test_words_go_there_and_back(spark):
    items = [(1.5, "a \"b\" é\n日本"), (None, "x"), (0.1 + 0.2, None), (-1e300, ""), (float("nan"), "n"), (float("inf"), "i")]
    df = spark.createDataFrame([(1, items), (2, []), (3, None)], "k int, items array<struct<x:double,text:string>>")
    got = {r["k"]: parsing.words_of(r["j"]) for r in df.select("k", F.to_json("items").alias("j")).collect()}
    assert got[2] == [] and got[3] == [] and [t for _, t in got[1]] == [t for _, t in items]
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for (a, _), (b, _) in zip(got[1], items) if b is not None) and got[1][1][0] is None


def test_the_parser_gets_flat_columns_of_lines_where_they_lie(spark):
    schema = "file_id string, page_no int, line_no int, text string, items array<struct<x:double,text:string>>"
    texts = ["DCB Bank", "Opening Balance 0.00", "05/03/2024", "UPI-A", "10.00 10.00", "06/03/2024", "UPI-B", "4.00 6.00"]
    df = spark.createDataFrame([("f", 1, k, x, None) for k, x in enumerate(texts)], schema).repartition(3)
    lying = df.withColumn("_k", F.row_number().over(Window.partitionBy("file_id").orderBy("text"))).filter("_k > 0").drop("_k")
    plan = parsing.parse_lines(lying)
    assert [(r["row_no"], r["withdrawal"], r["deposit"]) for r in plan.orderBy("row_no").collect()] == [(0, None, 10.0), (1, 4.0, None)]
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Exchange hashpartitioning") <= 1
