"""The Merkle manifest, the conversation trie and repeated passages against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import conv_trie, merkle, repeats

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- Merkle manifest --------------------------------------------------------


def plain_manifest(rows, fan):
    """(id, group, text) rows -> sorted (id, leaf, subroot, root, siblings)."""
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(map(say, r)))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k : k + fan])) for k in range(0, len(out[-1]), fan)])
        return out

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            b = i // fan * fan
            out.append((level[b:i], level[i + 1 : b + fan]))
            i //= fan
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, digest in enumerate(trees[g][0]):
            out.append((digest, trees[g][-1][0], top[-1][0], "".join("".join(a) + "".join(b) for a, b in siblings(trees[g], i) + siblings(top, k))))
    return sorted(out)


ROWS = [(i, "s%d" % (i % 4 if i % 3 else 0), f"text {i}\nü") for i in range(80)]
ROWS += [(None, None, None), (5, None, ""), (7, "", "x"), (9, "é", "y"), (9, "é", "y"), (9, "é", None), (-3, "s1", "neg")]


@pytest.mark.parametrize("fan,rows", [(3, ROWS), (2, ROWS[:11]), (3, ROWS[:1]), (3, [(1, "a", "t"), (2, "b", "t")]), (5, ROWS)])
def test_manifest_equals_the_plain_one(spark, fan, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("g", F.lit(1)).withColumn("_i", F.lit(2)).withColumn("proof", F.lit("other"))
    got = merkle.manifest(df, ("doc_id", "source", "text"), fan=fan)
    said = F.array_join(F.transform("proof", lambda s: F.concat(F.lower(F.hex(s["left"])), F.lower(F.hex(s["right"])))), "")
    out = got.select("leaf", "subroot", "root", said.alias("p"), "verified", "doc_id").collect()
    assert sorted(tuple(r)[:4] for r in out) == plain_manifest(rows, fan)
    assert all(r["verified"] for r in out) and sorted(map(str, (r["doc_id"] for r in out))) == sorted(str(r[0]) for r in rows)


def test_a_changed_row_fails_and_an_empty_table_has_no_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    changed = merkle.leaf_of([F.col("doc_id"), F.col("source"), F.when(F.col("doc_id") == 9, "z").otherwise(F.col("text"))])
    got = merkle.manifest(df, ("doc_id", "source", "text"), claim=changed).collect()
    assert all(r["verified"] == (r["doc_id"] != 9) for r in got)
    assert merkle.manifest(df.limit(0), ("doc_id", "source", "text")).count() == 0


# --- conversation trie ------------------------------------------------------


def plain_trie(convs):
    """{conv: [(role, text), ...]} -> sorted rows of all nodes."""
    nodes = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    size = lambda p: len(p[-1][1].encode()) if p else 0

    def below(path):
        out, todo = [], [path]
        while todo:
            p = todo.pop()
            out.append(p)
            todo += kids.get(p, [])
        return out

    rows = []
    for path, members in nodes.items():
        sub = below(path)
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        rows.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])), sum(p not in kids for p in sub),
            sum((len(nodes[p]) - 1) * size(p) for p in sub), H(",".join(map(str, ends))),
        ))
    return sorted(rows, key=str)


def made_conversations(rng, n):
    out = {}
    for c in range(n):
        kind = rng.random()
        if kind < 0.3:
            out[c * 3 - 20] = [("user", "hello"), ("bot", "hi")]  # one conversation that very many are
        elif kind < 0.35:
            out[c * 3 - 20] = [("u", "same")] * rng.randrange(1, 60)
        else:
            out[c * 3 - 20] = [(rng.choice(["u", "b"]), rng.choice(["é", "x", "", "long text"])) for _ in range(rng.randrange(1, 6))]
    return out


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_trie_equals_the_plain_one(spark, parts):
    convs = made_conversations(random.Random(parts), 120)
    rows = [(c, k * 2, r, t, "extra") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, "u", "t", "extra")], "conv_id long, turn long, role string, text string, depth string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in conv_trie.trie(conv_trie.turn_arrays(df)).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == plain_trie(convs)


def test_stitched_partitions_of_any_cut():
    """The sweep and the stitch alone, cut at random places, with empty and one-row partitions."""
    rng = random.Random(6)
    for _ in range(60):
        rows = sorted((bytes(rng.randrange(2) for _ in range(rng.randrange(0, 5))), c) for c in range(rng.randrange(1, 14)))
        wide = [(c, b"".join(bytes([x]) * 16 + (3 + x).to_bytes(8, "big") for x in key)) for key, c in rows]
        cuts = sorted(rng.choices(range(len(wide) + 1), k=rng.randrange(0, 5)))
        swept = [r for p, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(wide)])) if i < j for r in conv_trie.sweep(p, iter(wide[i:j]))]
        names = conv_trie.SWEPT.names
        opened = sorted((dict(zip(names, r)) for r in swept if r[0] in (1, 2, 3)), key=lambda r: (r["part"], r["kind"], r["depth"]))
        joined = [dict(zip(names, r)) for r in conv_trie.stitch(iter(opened))]
        known = [dict(zip(names, r)) for r in swept if r[0] == conv_trie.CLOSED] + joined
        low = {(r["part"], r["no"]): r["low"] for r in known}
        got = [(r["low"], r["depth"], low.get((r["part"], r["parent"])), r["n"], r["children"], r["leaves"], r["saved"], r["ends"]) for r in known if r["kind"] == conv_trie.CLOSED]
        convs = {c: [(str(x), "x" * (3 + x)) for x in key] for key, c in rows}
        assert sorted(got, key=str) == plain_trie(convs)


def test_turn_order_nulls_ties_and_an_empty_table(spark):
    rows = [(1, 2, "b", "two"), (1, None, None, None), (1, 2, "b", "two"), (2, None, "", ""), (2, 7, "b", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in conv_trie.trie(conv_trie.turn_arrays(df)).collect()]
    two = ("b", "two")
    assert sorted(got, key=str) == plain_trie({1: [("", ""), two, two], 2: [("", ""), two]})
    assert conv_trie.trie(conv_trie.turn_arrays(df.limit(0))).count() == 0


# --- repeated passages ------------------------------------------------------


def plain_repeats(rows):
    words = [(d, "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (t or "")).split(" ")) for d, t in rows]
    words = [(d, [w for w in ws if w]) for d, ws in words]
    first = {}
    for d, ws in words:
        for i in range(len(ws) - 49):
            key = tuple(ws[i : i + 50])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - 49):
            if d is not None and first.get(tuple(ws[i : i + 50]), d) < d:
                gone |= set(range(i, i + 50))
        out.append((d, len(ws), len(gone), H(" ".join(w for k, w in enumerate(ws) if k not in gone))))
    return sorted(out, key=str)


def made_texts(rng):
    words = [f"w{k}" for k in range(400)] + ["\x00odd", "Ü", "a b"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [some(n) for n in (50, 51, 49, 75, 200, 30, 120)]
    rows = []
    for d in range(90):
        text = some(rng.randrange(0, 90))
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, max(1, len(s) - 40))
            text += s[a:] + some(rng.randrange(0, 30))
        rows.append((d * 2, rng.choice([" ", "\n", "\t \r"]).join(text)))
    near = some(300)
    for d in range(25):
        copy = list(near)
        copy[rng.randrange(300)] = f"other{d}"
        rows.append((d * 2 + 1, " ".join(copy)))
    one = "one " * 160
    rows += [(500, rows[3][1]), (501, rows[100][1]), (502, rows[100][1] + " "), (502, "short text"), (502, rows[100][1]), (None, rows[100][1]), (503, None), (504, ""), (505, one), (506, one + "end"), (600, " ".join(some(4000)))]
    return rows + [rows[100]]


@pytest.mark.parametrize("phrases,part", [(repeats.SHARD_PHRASES, repeats.PART_BYTES), (3, 300)])
def test_repeats_equal_the_plain_version(spark, monkeypatch, phrases, part):
    monkeypatch.setattr(repeats, "SHARD_PHRASES", phrases)
    monkeypatch.setattr(repeats, "PART_BYTES", part)
    rows = made_texts(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("_sha", F.lit(1))
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == plain_repeats(rows)
    assert sum(r[2] > 0 for r in got) > 40


def test_repeats_with_other_identifiers_and_nothing_to_do(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([("b", text), ("a", text + " more"), ("c", "x " + text), (None, text)], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in repeats.remove_repeats(df).collect()}
    assert got == {"a": (0, None), "b": (60, ""), "c": (60, "x"), None: (0, None)}
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    assert repeats.remove_repeats(df.filter("doc_id = 'a'")).first()["n_removed"] == 0
