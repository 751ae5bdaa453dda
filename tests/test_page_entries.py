"""Entries of a page meet in one shuffle, as flat rows; rows with running numbers are shuffled once."""

import random

from pyspark.sql import functions as F

from ledgerlake.operators import balances, columnar, prefix


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def block_lines(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for page in range(1, 4):
        for head, texts in (
            ("TRANS DATE", [f"{k + 1:02d}/01/2024" for k in range(9)]),
            ("DESCRIPTION", [x for k in range(9) if rng.random() < 0.8 for x in ([f"BY TRF {k}", "END"] if k % 3 == 0 else [f"TO TRF {k}"])]),
            ("BALANCE", [f"{page * 1000 + rng.randrange(900)}.50" for _ in range(9)]),
        ):
            for x in (head, *texts):
                rows.append(("f", page, n, x))
                n += 1
    return spark.createDataFrame(rows, "file_id string, page_no int, line_no int, text string")


def test_a_page_is_no_nested_array(spark):
    lines = block_lines(spark)
    for by in ("aligned", "by_number"):
        got = columnar.transactions(lines, by=by)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "BatchEvalPython" not in plan and shuffles(got) <= 1
        rows = got.orderBy("page", "k").collect()
        assert len(rows) == 26 and [r["k"] for r in rows if r["page"] == 2] == list(range(1, 10))
        assert all((r["withdrawal"] is None) != (r["deposit"] is None) for r in rows)
        assert any(r["particulars"].endswith(" END") for r in rows)


def test_lost_descriptions_only_need_no_table():
    rng = random.Random(4)
    for _ in range(200):
        signs = [rng.choice([1, -1]) for _ in range(rng.randrange(1, 30))]
        told = [s if rng.random() < 0.8 else 0 for s in signs if rng.random() < 0.7]
        early = columnar.earliest(signs, told)
        assert early is not None and early == columnar.Band(signs, told, 40).path() == columnar.align(signs, told)
    assert columnar.earliest([1, 1], [-1]) is None


def test_running_rows_are_shuffled_once_and_nulls_are_a_group(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "", None]), rng.choice([1, 2, None]), k, rng.randrange(50)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, b int, seq int, balance int").repartition(3)
    got = prefix.running(df, ["g"], F.col("b"), ["seq"], "n", {"s": F.col("balance")})
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    want = {}
    for g in ("a", "b", "", None):
        total = 0
        for n, r in enumerate((r for r in order if r[0] == g), 1):
            total += r[3]
            want[r[2]] = (g, n, total)
    assert {r["seq"]: (r["g"], r["n"], int(r["s"])) for r in got.collect()} == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (prefix.running(df, ["g"], F.col("b"), ["seq"], "n", {}), balances.with_neighbour(df.select("g", "seq", "balance"), ("g",), False, "_before")):
            assert shuffles(plan) <= 4  # rows once; buckets three times
            assert len([x for x in plan.collect()]) == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
