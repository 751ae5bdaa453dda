"""The pipeline on a small table: every stage's decisions, held against plain Python."""

import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from ledgerlake.llm import bpe, decontam, langid, near_dedup
from tests.llm.test_similarity import brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}

    kept = cp.language_id(spark, docs, SF)
    rows = {r["doc_id"]: r for r in kept.collect()}
    model = langid.learn(docs.filter(~langid.held_out()))
    want = {r["doc_id"] for r in langid.classify(docs, model).collect() if not r["rejected"]}
    assert set(rows) == want and kept.columns == columns and len(rows) > 0.95 * len(before)

    lines = cp.dedup_lines(spark, kept, SF)
    after = {r["doc_id"]: r["text"] for r in lines.collect()}
    texts = {d: r["text"] for d, r in rows.items()}
    gone = brute_lines(list(texts.items()))
    expected = {}
    for d, t in texts.items():
        cut = [k for k in range(len(t.split("\n"))) if (d, t, k) in gone]
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        if not cut or left.strip(" ") != "":
            expected[d] = left
    assert after == expected and lines.columns == columns

    near = cp.near_dedup_stage(spark, lines, SF)
    ids = {r["doc_id"] for r in near.collect()}
    bags = {d: near_dedup.shingles_of(near_dedup.words_of(t)) for d, t in after.items()}
    parent = {d: d for d in after}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(after)
    for i, a in enumerate(order):
        for b in order[:i]:
            if bags[a] and bags[b] and near_dedup.bag_similar(bags[a], bags[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert ids == {d for d in after if root(d) == d} and near.columns == columns

    clean = cp.decontaminate(spark, near, SF)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = decontam.TestBlock(bench)
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(left) <= ids and clean.columns == columns
    for d in ids:
        words = decontam.words_of(after[d])
        hit = {p for _, _, _, at, n in decontam.match_shard([words], block) for p in range(at, at + n)}
        assert (d not in left) == (bool(hit) and 20 * len(hit) >= len(words))

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r["doc_id"]: r["n_tokens"] for r in cp.encode(spark, clean, SF).collect()}
    assert last == {d: len(enc.encode_ordinary(t)) for d, t in left.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in cp.run(spark, SF).collect()} == last
