"""Long pages: work in step with their length, results as for short ones."""

import random
import time

from ledgerlake.operators import parsing


def test_words_of_a_long_page_do_not_look_at_all_lines():
    n = 30_000
    began = time.monotonic()
    lines = parsing.grouped_lines([0.0, 50.0] * n, [-10.0 * (k // 2) for k in range(2 * n)], ["a", "b"] * n, 3.0)
    assert time.monotonic() - began < 20
    assert len(lines) == n and lines[0] == (0.0, [(0.0, "a"), (50.0, "b")])


def test_words_join_the_first_line_within_the_gap():
    def plain(ys, gap):
        lines = []
        for k, y in enumerate(ys):
            home = next((x for x in lines if abs(x[0] - y) <= gap), None)
            if home is None:
                lines.append([y, 1, [(float(k), "w")]])
            else:
                home[0], home[1] = (home[0] * home[1] + y) / (home[1] + 1), home[1] + 1
                home[2].append((float(k), "w"))
        return [(x[0], sorted(x[2])) for x in sorted(lines, key=lambda x: -x[0])]

    rng = random.Random(3)
    for gap in (0.0, 0.5, 3.0):
        for _ in range(60):
            ys = [rng.choice([rng.uniform(-30, 30), float(rng.randint(-8, 8))]) for _ in range(80)]
            assert parsing.grouped_lines([float(k) for k in range(80)], ys, ["w"] * 80, gap) == plain(ys, gap)
