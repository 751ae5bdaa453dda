"""Clustering in rounds against the greedy rule, account by account."""

import random

from ledgerlake.functions import names
from ledgerlake.operators.clustering import candidates, clustered


def made_names(rng: random.Random, n: int) -> list[str]:
    words = ["RAHUL", "KUMAR", "SHARMA", "GANESH", "TRADERS", "MAHALAXMI", "ENTERPRISES", "PATIL", "JOSHI", "KUM", "CONSTRUCTIONS", "AB", "SHREE", "VENKATESHWARA"]
    out = []
    for _ in range(n):
        name = [rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 7, 8]))]
        if rng.random() < 0.6:
            k = rng.randrange(len(name))
            w = name[k]
            i = rng.randrange(len(w))
            name[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + "X" + w[i:], w[:i] + "Q" + w[i + 1 :], w[: max(3, len(w) - 3)], w[2:]]) or w
        out.append(" ".join(name))
    return out


def test_equal_to_the_greedy_rule(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for account in range(6):
        labels = list(dict.fromkeys(made_names(rng, 150 if account else 1)))
        shown = names.clusters(labels)
        want.update({(account, x): shown.get(names.cluster_key(x), x) for x in labels})
        rows += [(account, x, i // 3, i) for i, x in enumerate(labels)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "account_id long, label string, day long, seq long")
    got = {(r["account_id"], r["label"]): r["canonical"] for r in clustered(df, ("account_id",), ("day", "seq")).collect()}
    assert got == want
    assert len({*want.values()}) < len(want)
    assert clustered(df.limit(0), ("account_id",), ("day", "seq")).count() == 0


def test_blocks_miss_no_pair(spark):
    rng = random.Random(5)
    keys = sorted({names.cluster_key(x) for x in made_names(rng, 400)})
    df = spark.createDataFrame([(1, k) for k in keys], "_a long, key string")
    got = {(r["x"], r["y"]) for r in candidates(df).collect()}
    alike = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if names.similar_keys(a, b) or names.similar_keys(b, a)}
    assert alike <= got and len(alike) > 300 and len(got) < len(keys) * (len(keys) - 1) / 3
