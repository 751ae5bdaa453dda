"""Tables read column by column, and the alignment of their blocks."""

import itertools
import random
from datetime import date

from ledgerlake.operators import columnar


def brute(signs, told):
    """The least cost over all order-keeping pairings."""
    best = None
    for k in range(min(len(signs), len(told)) + 1):
        for a in itertools.combinations(range(len(signs)), k):
            for b in itertools.combinations(range(len(told)), k):
                pairs = sum(columnar.UNKNOWN_COST if told[j] == 0 else 0 if told[j] == signs[i] else columnar.CONFLICT_COST for i, j in zip(a, b))
                cost = pairs + columnar.GAP_COST * (len(signs) + len(told) - 2 * k)
                best = cost if best is None else min(best, cost)
    return best


def test_alignment_has_the_least_cost():
    rng = random.Random(1)
    for _ in range(150):
        signs = [rng.choice([1, -1]) for _ in range(rng.randrange(0, 6))]
        told = [rng.choice([1, -1, 0]) for _ in range(rng.randrange(0, 6))]
        found = columnar.align(signs, told)
        used = [j for j in found if j is not None]
        assert used == sorted(set(used)) and len(found) == len(signs)
        pairs = [(i, j) for i, j in enumerate(found) if j is not None]
        cost = sum(columnar.UNKNOWN_COST if told[j] == 0 else 0 if told[j] == signs[i] else columnar.CONFLICT_COST for i, j in pairs)
        assert cost + columnar.GAP_COST * (len(signs) + len(told) - 2 * len(pairs)) == brute(signs, told)
    assert columnar.align([1, -1, 1], [1, 1]) == [0, None, 1] and columnar.align([], [1]) == []


LINES = """Total Debit Amount
1,500.00
TRANS DATE
05-01-2024
junk
06-01-2024
DESCRIPTION
B/F
BY TRF SALARY
JANUARY
TO TRF RENT
BALANCE
1,000.00
3,000.00
1,500.00
1,500.00
99,999,999.00
TRANS DATE
07/01/2024
REFF
08/01/2024
DESCRIPTION
BY CTS CLEARING
BALANCE
1,400.00
1,600.00
BALANCE
5.00"""


def lines_of(spark, text, file_id="f"):
    rows = [(file_id, 1, k, x) for k, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file_id string, page_no int, line_no int, text string")


def test_pages_sections_and_the_balance_carried_over(spark):
    lines = lines_of(spark, LINES)
    got = columnar.transactions(lines, by="by_number").orderBy("page", "k").collect()
    assert [(r["page"], r["txn_date"], r["particulars"], r["withdrawal"] and float(r["withdrawal"]), r["deposit"] and float(r["deposit"]), float(r["balance"])) for r in got] == [
        (1, date(2024, 1, 5), "BY TRF SALARY JANUARY", None, 2000.0, 3000.0),
        (1, date(2024, 1, 6), "TO TRF RENT", 1500.0, None, 1500.0),
        (2, date(2024, 1, 7), "BY CTS CLEARING", 100.0, None, 1400.0),
        (2, date(2024, 1, 8), "TRANSACTION", None, 200.0, 1600.0),
    ]
    better = {(r["page"], r["k"]): r["particulars"] for r in columnar.transactions(lines).collect()}
    assert better[2, 1] == "TRANSACTION" and better[2, 2] == "BY CTS CLEARING" and better[1, 1] == "BY TRF SALARY JANUARY"
    assert [tuple(r) for r in columnar.printed_totals(lines).collect()] == [("f", 1500.0, None, None)]
    trail = columnar.transactions(lines, by="by_number", trail=(1000, 600_000)).count()
    assert trail == 4 and columnar.transactions(lines.limit(0)).count() == 0
