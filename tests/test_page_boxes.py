"""The boxes of a page come to one task once; its lines against a sweep box by box."""

import math
import random

from ledgerlake.operators import boxes

BOXES = "file_id string, page_no int, x0 double, y0 double, x1 double, y1 double, text string"


def sweep(page, degrees):
    """One box after the other, in the order of the top, then x, then the words."""
    turned = []
    for x0, y0, x1, y1, text in page:
        if None in (x0, y0, x1, y1):
            turned.append(((0, 0.0), (0, 0.0) if x0 is None else (1, x0), text.encode(), None, x0, text))
            continue
        shift, high = (x0 + x1) / 2 * math.tan(math.radians(degrees)), (y1 - y0) * boxes.SHRINK
        turned.append(((1, y0 - shift + high), (1, x0), text.encode(), y1 - shift - high, x0, text))
    lines, reached = [], None
    for top, _, _, bottom, x0, text in sorted(turned, key=lambda b: b[:3]):
        if top[0] == 0 or reached is None or top[1] > reached:
            lines.append([])
        lines[-1].append((x0, text))
        reached = bottom if reached is None else reached if bottom is None else max(reached, bottom)
    order = lambda i: ((0, 0.0) if i[0] is None else (1, i[0]), i[1].encode())
    return [" ".join(text for _, text in sorted(line, key=order)) for line in lines]


def test_lines_of_pages_with_odd_boxes(spark):
    rng = random.Random(8)
    pages = {}
    for p in range(6):
        slope = math.tan(math.radians((p - 3) * 0.5))
        page = []
        for r in range(25):
            for k in range(rng.randrange(1, 5)):
                y = r * 20 + (k * 70 + 30) * slope + rng.randrange(3)
                page.append((k * 70.0, y, k * 70.0 + 60, y + 10, rng.choice(["é", "z", "word", "Z", "日本"])))
        page += [page[0], (None, 5.0, 6.0, 7.0, "no x"), (3.0, None, 6.0, 7.0, "no y"), (3.0, None, 6.0, 7.0, "a")]
        rng.shuffle(page)
        pages[p] = page
    df = spark.createDataFrame([("f", p, *b) for p, page in pages.items() for b in page] + [("f", 0, 1.0, 1.0, 2.0, 2.0, "  ")], BOXES)
    skew = {r["page_no"]: r["degrees"] for r in boxes.page_skew(df.filter("trim(text) <> ''")).collect()}
    found = boxes.lines_of_boxes(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {}
    for r in found.orderBy("page_no", "line_no").collect():
        got.setdefault(r["page_no"], []).append(r["text"])
        assert r["text"] == " ".join(i["text"] for i in r["items"])
    assert got == {p: sweep(page, skew[p]) for p, page in pages.items()}
    assert boxes.lines_of_boxes(df.limit(0)).count() == 0
