"""Boxes, ledger matching and the override log against plain versions."""

import json
import random

from pyspark.sql import functions as F

from ledgerlake.operators import boxes, history, matching, overrides


def test_lines_on_a_page_that_is_askew(spark):
    words = [("f", 1, x * 60.0, y * 14.0 + x * 60.0 * 0.0524, x * 60.0 + 50, y * 14.0 + x * 60.0 * 0.0524 + 12, f"w{y}-{x}") for y in range(6) for x in range(8)]
    words += [("g", 1, 0.0, 0.0, 5.0, 5.0, "only"), ("g", 1, 9.0, 0.0, 5.0, 5.0, None), ("g", 2, 9.0, 0.0, 5.0, 5.0, "  ")]
    df = spark.createDataFrame(words, "file_id string, page_no int, x0 double, y0 double, x1 double, y1 double, text string")
    assert boxes.page_skew(df.filter("file_id = 'f'")).first()["degrees"] == 3.0
    got = boxes.lines_of_boxes(df).orderBy("file_id", "line_no").collect()
    assert [(r["file_id"], r["line_no"], r["text"]) for r in got] == [("f", y + 1, " ".join(f"w{y}-{x}" for x in range(8))) for y in range(6)] + [("g", 1, "only")]


def test_orientation_stops_early_and_ties_go_to_the_first(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file_id string, page_no int")
    asked = []

    def read(left, rotation):
        asked.append({(r["file_id"], r["page_no"]) for r in left.collect()})
        text = F.when((F.col("page_no") == 1) & (F.col("file_id") == "a"), "1/2/2020 3/4/2020").otherwise("no dates")
        return left.select("file_id", "page_no", text.alias("text"), F.when(F.col("file_id") == "b", float(rotation)).otherwise(1.0).alias("confidence"))

    got = {(r["file_id"], r["page_no"]): (r["rotation"], r["score"]) for r in boxes.oriented(pages, read, enough=2).collect()}
    assert got == {("a", 1): (0, 2001.0), ("a", 2): (0, 1.0), ("b", 1): (180, 180.0)}
    assert asked == [{("a", 1), ("a", 2), ("b", 1)}, {("a", 2), ("b", 1)}]


def greedy(manual, computed):
    def key(x):
        return " ".join("".join(c if c.isalnum() else " " for c in (x or "").upper()).split())

    def long(k):
        return [w for w in dict.fromkeys(k.split()) if len(w) > 3]

    pairs = []
    for mi, mn, ma in manual:
        for ci, cn, ca in computed:
            m, c = key(mn), key(cn)
            if not m or not c:
                continue
            near = m[:10] in c or c[:10] in m
            words = sum(any(x in y or y in x for y in long(c)) for x in long(m))
            if near or words >= 2:
                pairs.append((not near, -words, abs(ma - ca) if ma is not None and ca is not None else float("inf"), mi, ci))
    out = set()
    for _, _, _, mi, ci in sorted(pairs):
        if all(mi != a and ci != b for a, b in out):
            out.add((mi, ci))
    return out


def test_assignment_equals_taking_the_best_first(spark):
    rng = random.Random(7)
    words = ["SHREE", "GANESH", "TRADERS", "OM", "STORES", "KIRANA", "PATIL", "AB", "STORE", "TRADE"]
    name = lambda: rng.choice([" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), "", None, "X", "m/s " + rng.choice(words)])
    data = {a: [[(k, name(), rng.choice([None, float(rng.randrange(5))])) for k in range(25)] for _ in range(2)] for a in (1, 2)}
    side = lambda i: spark.createDataFrame([(a, *r) for a, both in data.items() for r in both[i]], "account_id long, id long, name string, amount double")
    got = matching.assigned(side(0), side(1)).collect()
    for a, (m, c) in data.items():
        assert {(r["manual_id"], r["computed_id"]) for r in got if r["account_id"] == a} == greedy(m, c)
    assert matching.assigned(side(0).limit(0), side(1)).count() == 0


def test_log_and_snapshots(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1, k, f"t{rng.randrange(6)}", rng.choice(["assign", "exclude", "restore", "reset"]), rng.choice("AB"), k // 3) for k in range(90)]
    log = spark.createDataFrame(rows, "account_id long, seq long, txn_id string, action string, party string, at long")
    twice = history.merged(history.merged(log.filter("seq < 50"), log.filter("seq > 30")), log)
    assert twice.count() == 90
    asks = spark.createDataFrame([(1, x) for x in (0, 7, 15, 29)], "account_id long, ask_at long")
    whole = {x: {tuple(r) for r in overrides.effective_assignments(log.filter(F.col("at") <= x)).select("txn_id", "party", "status").collect()} for x in (0, 7, 15, 29)}
    for shots in ([5, 15], [40], [0]):
        got = history.as_of(history.snapshots_at(log, shots), twice, asks).collect()
        for x, want in whole.items():
            assert {(r["txn_id"], r["party"], r["status"]) for r in got if r["ask_at"] == x} == want
    good = {"events": [{"seq": 1, "txn_id": "t", "action": "assign", "party": "A", "at": 3}]}
    (tmp_path / history.store_name("a/1")).write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"events": [{"seq"')
    assert [tuple(r) for r in history.read_stores(spark, str(tmp_path)).collect()] == [("a_1", 1, "t", "assign", "A", 3)]
