"""Alignment in a band: the same as over the whole table, and in the time and memory of long pages."""

import random
import time

import numpy as np

from ledgerlake.operators import columnar
from ledgerlake.operators.columnar import CONFLICT_COST, GAP_COST, UNKNOWN_COST


def whole(signs, told):
    n, m = len(signs), len(told)
    cost = np.zeros((n + 1, m + 1), dtype=np.int64)
    cost[n, :] = GAP_COST * np.arange(m, -1, -1)
    cost[:, m] = GAP_COST * np.arange(n, -1, -1)
    pair = lambda i, j: UNKNOWN_COST if told[j] == 0 else 0 if told[j] == signs[i] else CONFLICT_COST
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            cost[i, j] = min(cost[i + 1, j + 1] + pair(i, j), cost[i + 1, j] + GAP_COST, cost[i, j + 1] + GAP_COST)
    out, i, j = [], 0, 0
    while i < n:
        if j < m and cost[i, j] == cost[i + 1, j + 1] + pair(i, j):
            out.append(j)
            i, j = i + 1, j + 1
        elif j < m and cost[i, j] == cost[i, j + 1] + GAP_COST:
            j += 1
        else:
            out.append(None)
            i += 1
    return out


def test_band_equals_the_whole_table(monkeypatch):
    rng = random.Random(7)
    for slack in (0, 1, 64):
        monkeypatch.setattr(columnar, "SLACK", slack)
        for _ in range(150):
            signs = [rng.choice((-1, 1)) for _ in range(rng.randint(0, 40))]
            told = [rng.choice((-1, 0, 1)) for _ in range(rng.randint(0, 40))]
            assert columnar.align(signs, told) == whole(signs, told)
            near = [rng.choice((s, s, s, 0, -s)) for s in signs if rng.random() > 0.2]
            assert columnar.align(signs, near) == whole(signs, near)


def test_a_page_of_twenty_thousand_changes():
    rng = random.Random(1)
    signs = [rng.choice((-1, 1)) for _ in range(20_000)]
    kept = [s for s in signs if rng.random() > 0.05]
    began = time.monotonic()
    out = columnar.align(signs, kept)
    assert time.monotonic() - began < 60
    assert [x for x in out if x is not None] == list(range(len(kept)))
