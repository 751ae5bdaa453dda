"""Statements with very many rows."""

import time

from ledgerlake.operators import normalize


def test_rows_do_not_carry_their_statement(spark):
    rows = spark.range(1).selectExpr(
        "'a' AS analysis_id", "'P' AS applicantName",
        "array(named_struct('fileName', 'hdfc.pdf', 'accountInfo', array(named_struct('label', 'Account Number', 'value', '0012345')), 'transactions', "
        "transform(sequence(1, 20000), i -> named_struct('date', '2024-01-05', 'particulars', concat('UPI ', i), 'narration', '', 'withdrawal', 5D, 'deposit', 0D, 'balance', double(i))))) AS statements",
    )
    began = time.monotonic()
    found = normalize.normalize(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    carried = [x for x in plan.splitlines() if "Generate posexplode(transactions" in x]
    assert len(carried) == 1
    got = found.selectExpr("count(*)", "count(DISTINCT txn_id)", "max(bank_name)", "max(account_suffix)", "max(balance)").first()
    assert [str(x) for x in got] == ["20000", "20000", "HDFC Bank", "2345", "20000.00"]
    assert time.monotonic() - began < 60
