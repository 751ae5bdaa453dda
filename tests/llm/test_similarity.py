"""Line dedup and near-dedup against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import line_dedup, near_dedup

WORDS = [f"word{i}" for i in range(40)] + ["é", "the", "of"]


def line_words(line):
    return frozenset(line.encode().translate(line_dedup.WORDS).split())


def brute_lines(rows):
    """Removed (row identity, line) and kept texts; rows of equal id and text are one."""
    lines = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line_words(line):
                lines.append((d, t, k, line_words(line)))
    gone = set()
    for i, (d, t, k, w) in enumerate(lines):
        for *_, x in lines[:i]:
            both = len(w & x)
            if 5 * both >= 4 * (len(w) + len(x) - both):
                gone.add((d, t, k))
                break
    return gone


def variant(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS)
    return words


def corpus(rnd, n, base_lines, edits=2):
    out = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            if rnd.random() < 0.5:
                lines.append(" ".join(variant(rnd, rnd.choice(base_lines), rnd.randrange(edits + 1))))
            else:
                lines.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 25))))
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("hot,sure", [(line_dedup.HOT, line_dedup.SURE), (3, 1)])
def test_line_dedup_brute_force(spark, monkeypatch, hot, sure):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rnd = random.Random(hot)
    base = [[rnd.choice(WORDS) for _ in range(rnd.randrange(6, 22))] for _ in range(5)]
    rows = corpus(rnd, 60, base)
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "The of THE\n!!\nthe, of"), (None, rows[3][1]), (104, rows[5][1]), (104, rows[5][1])]
    rows += [(105, "a b c d"), (106, "a b c d e\nlast A, B c e d"), (107, " ".join(f"t{i}" for i in range(3000)))]
    rows += [(110 + k, " ".join(f"t{i}" for i in range(n) if i % 37 != k)) for k, n in enumerate((3000, 2800, 400, 390, 120, 118, 230, 240, 90))]
    rows += [(130, "z" * 200 + " a b c d"), (131, "A b c d " + "z" * 200), (132, "z" * 199 + " a b c d")]
    gone = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if (d, t, k) not in gone]
        want.append((str(d), None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted(map(str, want)) == sorted(str((str(r["doc_id"]), r["text"], r["_ld_lines"], r["_ld_removed"])) for r in got)


def test_line_dedup_large_group_of_variants(spark):
    rnd = random.Random(1)
    base = [f"x{i}" for i in range(30)]
    rows = [(i, " ".join(w if rnd.random() > 0.04 else f"r{rnd.randrange(10**6)}" for w in base)) for i in range(1500)]
    gone = {d for d, *_ in brute_lines(rows)}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["_ld_removed"]}
    assert got == gone


def test_pairs_second_pass_finds_what_the_first_left(spark):
    # many likely partners that fail and one, far in weight order, that holds
    n = 400
    key = np.zeros(n, dtype=np.int64)
    size = np.full(n, 10)
    parity = line_dedup.Parities(pa.array([bytes(16)] * n, pa.binary()))
    order = np.arange(n)
    later, earlier, _, stopped = line_dedup.pairs_of(key, size, np.zeros(n, dtype=np.int64), parity, order, 2, np.ones(n, dtype=bool))
    assert stopped[-1]
    later, earlier, *_ = line_dedup.pairs_of(key, size, np.zeros(n, dtype=np.int64), parity, order, 1 << 40, order == n - 1)
    assert set(zip(later, earlier)) == {(n - 1, j) for j in range(n - 1)}


def test_parities_of_lines_where_a_level_between_is_missing():
    short, long = (np.random.default_rng(1).integers(0, 1 << 63, n, dtype=np.uint64) for n in (2, 8))  # 128 and 512 bits, none of 256
    parity = line_dedup.Parities(pa.array([short.tobytes(), long.tobytes()], pa.binary()))
    folded = np.bitwise_xor.reduce(long.reshape(-1, 2), axis=0)
    assert parity.distance(np.array([0]), np.array([1])).tolist() == [int(np.bitwise_count(short ^ folded).sum())]


def test_parities_are_those_of_each_line_by_itself():
    hashes, sizes = line_dedup.mixed(np.arange(1, 311, dtype=np.uint64), 1), np.array([10, 300])
    both = line_dedup.parities(hashes, np.array([0, 10]), sizes)
    assert [len(x.as_py()) for x in both] == [16, 64]
    assert both[1].as_py() == line_dedup.parities(hashes[10:], np.array([0]), sizes[1:])[0].as_py()


def test_line_dedup_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b\na b", "x", 7)], "doc_id long, text string, d string, h int")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    r = line_dedup.dedup_lines(df).first()
    assert (r["text"], r["d"], r["h"], r["_ld_removed"]) == ("a b", "x", 7, 1)


def brute_groups(rows):
    bags = [near_dedup.shingles_of(near_dedup.words_of(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and near_dedup.bag_similar(bags[i], bags[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = groups[root(i)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids)))
    return sorted(map(str, out))


def test_near_duplicates_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(30, 400))]
        for _ in range(rnd.randrange(1, 6)):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, len(base) // 100, len(base) // 40])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    rows += [(200, "short text"), (201, "Short, text!"), (202, ""), (203, None), (204, "a b " * 50), (205, "a b " * 55), (206, "a b " * 20)]
    rows += [(None, rows[0][1]), (207, rows[0][1]), (207, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == brute_groups(rows)
    kept = near_dedup.drop_near_duplicates(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_large_group(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(250)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"q{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == brute_groups(rows)


def test_bag_min_hash_is_unbiased():
    rnd = random.Random(2)
    for _ in range(4):
        a = Counter({i: rnd.choice([1, 1, 2, 3, 9, 40]) for i in range(rnd.randrange(5, 200))})
        b = Counter({i: (n if rnd.random() < 0.7 else rnd.randrange(1, 12)) for i, n in a.items() if rnd.random() < 0.9})
        b.update({10**6 + i: 2 for i in range(5)})
        want = sum((a & b).values()) / sum((a | b).values())
        hits = 0
        rounds = 40
        for k in range(rounds):
            doc = np.array([0] * len(a) + [1] * len(b))
            el = np.array([*a, *b], dtype=np.uint64) * np.uint64(2654435761) + np.uint64(k * 10**12)
            sig = near_dedup.bag_min_hash(doc, near_dedup.mixed(el), np.array([*a.values(), *b.values()]), 2)
            hits += (sig[0] == sig[1]).mean() / rounds
        assert abs(hits - want) < 0.03


def test_signature_does_not_depend_on_block():
    doc, el, w = np.array([0, 0, 1]), np.array([5, 9, 5], dtype=np.uint64), np.array([2, 1, 7])
    both = near_dedup.bag_min_hash(doc, el, w, 2)
    assert (both[1] == near_dedup.bag_min_hash(np.array([0]), el[2:], w[2:], 1)[0]).all()
    assert np.isinf(near_dedup.bag_min_hash(doc[:0], el[:0], w[:0], 1)).all()


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(30) if i % 7] + [(rnd.randrange(50, 90), rnd.randrange(50, 90)) for _ in range(30)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges if a != b], "c binary, e binary")
    got = {r["c"][0]: r["label"][0] for r in near_dedup.components(df).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent if root(x) != x}


def brute_by(rows, rank):
    """Removed (identifier, text, line), with the rows in the order of rank."""
    seen, gone = [], set()
    for d, t in sorted(set(rows), key=rank):
        for k, line in enumerate((t or "").split("\n")):
            w = line_words(line)
            if w and any(5 * len(w & x) >= 4 * len(w | x) for x in seen):
                gone.add((d, t, k))
            if w:
                seen.append(w)
    return gone


def cut_texts(rows, gone):
    return sorted((str(d), "\n".join(x for k, x in enumerate(t.split("\n")) if (d, t, k) not in gone)) for d, t in rows)


@pytest.mark.parametrize("kind", ["long", "string", "tied"])
def test_line_dedup_order_of_any_identifier(spark, kind):
    rnd = random.Random(11)
    base = [[rnd.choice(WORDS) for _ in range(14)] for _ in range(3)]
    made = [t for _, t in corpus(rnd, 40, base)]
    if kind == "long":  # far beyond 2**53, and next to each other
        ids = [(1 << 60) + k for k in range(20)] + [-(1 << 61) + k for k in range(20)]
    elif kind == "string":
        ids = [None, ""] + [f"é{k}" if k % 3 else f"Z{k}" for k in range(38)]
    else:
        ids = [k // 4 for k in range(40)]
    rows = list(zip(ids, made))
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'string' else 'long'}, text string")
    hashes = {t: h for t, h in df.selectExpr("text", "xxhash64(text)").collect()}
    rank = lambda r: (r[0] is not None, (r[0] or "").encode() if kind == "string" else r[0], hashes[r[1]])
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(df.repartition(5)).collect())
    assert got == cut_texts(rows, brute_by(rows, rank))


def test_line_number_beyond_2_to_the_20_is_kept_in_order(spark):
    text = "\n" * (1 << 20) + "a b c d e f\n" + "a b c d e g\n" * 2 + "b c d e f a g"
    r = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["text"].strip("\n") == "a b c d e f\na b c d e g" and r["_ld_removed"] == 2


def test_a_key_of_very_many_lines_is_split(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP", 30)
    monkeypatch.setattr(line_dedup, "LOOKED_AT", 1)
    rnd = random.Random(5)
    base = [f"x{i}" for i in range(30)]
    rows = [(i, " ".join(w if rnd.random() > 0.04 else f"r{rnd.randrange(10**6)}" for w in base)) for i in range(300)]
    rows += [(300 + i, " ".join([*base[:3], *(f"s{rnd.randrange(10**6)}" for _ in range(12))])) for i in range(300)]
    gone = {d for d, *_ in brute_lines(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.dedup_lines(df).collect() if r["_ld_removed"]} == gone


def test_line_dedup_clashing_columns(spark):
    extra = ["_ld_key", "_ld_gone", "_ld_d", "_ld_h", "_LD_GONE_", "c1", "keys", "sought", "_ld_lines"]
    df = spark.createDataFrame([(1, "a b\na b", *extra)], ["doc_id", "text", *extra])
    r = line_dedup.dedup_lines(df).first()
    assert r["text"] == "a b" and r["_ld_lines"] == 2 and all(r[c] == c for c in extra if c != "_ld_lines")


@pytest.mark.parametrize("group", [7, 40])
def test_near_band_values_of_very_many_rows_are_split(spark, monkeypatch, group):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rnd = random.Random(6)
    rows = []
    for g in range(3):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for i in range(70):
            words = list(base)
            for _ in range(rnd.randrange(4) if i % 3 else rnd.randrange(2, 9)):  # some chains, some strays
                words[rnd.randrange(len(words))] = f"q{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == brute_groups(rows)


def test_recall_against_brute_force_on_documents(spark):
    """All links of similarity 0.8 and more between the documents of the smallest
    tables, found by comparing each with each."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"])) for r in got) == brute_groups(rows)


def keys_of_sets(sets, levels):
    """prefix_keys of lines given as sets of word numbers, with a rarity level per word."""
    rows = [np.sort(np.array([(levels[w] << line_dedup.HASH_BITS) | (w * 7919 % 1_000_003) for w in s], dtype=np.int64)) for s in sets]
    sizes = np.array([len(r) for r in rows])
    keys, _, lines = line_dedup.prefix_keys(np.concatenate(rows), np.cumsum(sizes) - sizes, sizes)
    return [set(keys[lines == i].tolist()) for i in range(len(sets))]


def test_long_similar_lines_of_hot_words_share_a_key():
    rng = random.Random(11)
    hot = int(np.log2(line_dedup.HOT) * 1024) + 1
    for trial in range(120):
        n = rng.choice([4, 9, 40, 70, 130, 400, 900])
        words = rng.sample(range(100_000), 2 * n)
        levels = {w: hot + rng.randrange(500) if trial % 3 else hot - 200 + rng.randrange(400) for w in words}
        a, spare = set(words[:n]), words[n:]
        b = set(a)
        for w in rng.sample(sorted(a), rng.randrange(0, n // 8 + 1)):  # worst for pairs: the gaps lie anywhere
            b.remove(w)
        b |= set(spare[: rng.randrange(0, n // 8 + 1)])
        if len(a & b) / len(a | b) >= 0.8 and len(a) > 3 and len(b) > 3 and a != b:
            x, y = keys_of_sets([a, b], levels)
            assert x & y


def test_keys_of_a_very_long_line_of_hot_words_stay_few():
    n = 100_000
    word = (np.int64(20 * 1024) << line_dedup.HASH_BITS) | np.arange(n, dtype=np.int64)
    tracemalloc.start()
    keys, places, _ = line_dedup.prefix_keys(word, np.array([0]), np.array([n]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) < line_dedup.GAP * n / 4 and peak < 400 << 20 and not places.any()
