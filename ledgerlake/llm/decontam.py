"""Benchmark decontamination with training suffix arrays.

A shard is a block of whole training documents, up to SHARD_BYTES of text.  Its words are mapped to
the vocabulary of the test texts; a suffix that starts outside that vocabulary,
or in a stretch of test words shorter than the shortest window, can hold no
window, so the shard's suffix array covers just the other suffixes (a sparse
suffix array, sorted by prefix doubling).  Every test suffix is then looked up
by binary search, all at once: the range that shares its first window gives all
locations, and each is extended to the longest verbatim match.  Shards need
nothing of each other, so documents are never shuffled.

A window is WINDOW consecutive words of an item; an item with fewer words (but
some) is one window.  A document word inside any occurrence of a window is hit,
and a document is contaminated if ``n_hit > 0 and ratio * n_hit >= n_words``.

The test set is a query set held against all rows in blocks: each block of
items is bounded by BLOCK_BYTES of text and broadcast by itself.  With one block the
rows pass through one map.  With more, the matches of each block are written to a
table of their own, its broadcast is given up before the next, and the rows get
their matches by a join on hashes of the text, so a test set of any size works.

Defined cases: words are maximal runs of letters, digits and non-ASCII, after
lower-casing A-Z; a null text has no words and is clean; an item without words
matches nothing; repeated items each count; an empty test set or an empty table
is fine.  Columns are carried along; in find_matches and mark an input column called
like an output column (``_dc_...``) is replaced, decontaminate keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, fresh_names, materialize, pieces_of, tidied

WINDOW = 13
RATIO = 20
SHARD_BYTES = 2 << 20
NEEDLES = 50_000
BLOCK_BYTES = 16 << 20
#: A-Z to lower case; ASCII that is neither letter nor digit to a space.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


class TestBlock:
    """Test items of one block: vocabulary, word ids and windows."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[object, list[int]]] = []
        for key, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                self.items.append((key, ids))
        self.window = window
        self.shortest = min((min(window, len(x)) for _, x in self.items), default=window)
        self.longest = max((len(x) for _, x in self.items), default=0)
        #: By length of window: (item, place in it) of each, and their words as rows.
        self.needles: dict[int, tuple[list[tuple[int, int]], np.ndarray]] = {}
        for k in sorted({min(window, len(x)) for _, x in self.items}):
            at = [(n, j) for n, (_, x) in enumerate(self.items) if min(window, len(x)) == k for j in range(len(x) - k + 1)]
            self.needles[k] = at, np.array([self.items[n][1][j : j + k] for n, j in at], dtype=np.int64)


def ids_of(words: list[bytes], block: TestBlock) -> np.ndarray:
    """The words as numbers of the test vocabulary, 0 for others."""
    get = block.vocab.get
    return np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))


def bounds(text: np.ndarray, order: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the suffix array the suffixes that start with each needle begin and
    end, by binary searches for all needles at once."""
    m, k = needles.shape
    step = np.arange(k)
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(order), dtype=np.int64)
        while (on := np.flatnonzero(lo < hi)).size:
            mid = (lo[on] + hi[on]) // 2
            differs = text[np.minimum(order[mid, None] + step, len(text) - 1)] - needles[on]
            first = (differs != 0).argmax(axis=1)
            sign = differs[np.arange(len(on)), first]
            after = sign <= 0 if upper else sign < 0
            lo[on], hi[on] = np.where(after, mid + 1, lo[on]), np.where(after, hi[on], mid)
        out.append(lo)
    return out[0], out[1]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the suffix that starts there, compared to depth words
    at least; 0 ends a stretch and sorts first."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    rank = ids.astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if h < n:
            second[:-h] = rank[h:]
        key = rank * (int(rank.max()) + 1) + np.where(rank > 0, second, 0)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], (np.diff(sorted_key) > 0).astype(np.int64)])) + 1
        fresh[ids == 0] = 0
        h *= 2
        if h >= depth or fresh.max() == n:
            return order
        rank = fresh


def match_shard(docs: list[list[bytes]], block: TestBlock) -> list[tuple[int, object, int, int, int]]:
    return match_ids([ids_of(words, block) for words in docs], block)


def match_ids(docs: list[np.ndarray], block: TestBlock) -> list[tuple[int, object, int, int, int]]:
    """All occurrences: (document, item, place in item, place in document, words).

    Each is a longest verbatim match that holds a window: an occurrence of a
    window is extended to the left and right as far as both texts agree.
    """
    parts, doc_of = [], []
    for d, ids in enumerate(docs):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= block.shortest:
                parts.append(ids[a:b])
                parts.append(np.zeros(1, dtype=np.int32))
                doc_of.append((d, a, b - a + 1))
    if not parts or not block.items:
        return []
    text = np.concatenate(parts).astype(np.int64)
    doc = np.repeat([x[0] for x in doc_of], [x[2] for x in doc_of])
    place = np.concatenate([np.arange(a, a + n) for _, a, n in doc_of])
    order = suffix_array(text, block.longest + 1)
    order = order[text[order] > 0]
    found: set[tuple[int, object, int, int, int]] = set()
    for at, words in block.needles.values():
        for a in range(0, len(at), NEEDLES):
            low, high = bounds(text, order, words[a : a + NEEDLES])
            for r in np.flatnonzero(low < high):
                n, j = at[a + r]
                key, item = block.items[n][0], np.array(block.items[n][1], dtype=np.int64)
                for p in order[low[r] : high[r]]:
                    if j and p and text[p - 1] == item[j - 1] and doc[p - 1] == doc[p]:
                        continue  # inside the match that starts further left
                    m = min(len(item) - j, len(text) - p)
                    same = text[p : p + m] == item[j : j + m]
                    length = m if same.all() else int(np.argmin(same))
                    found.add((int(doc[p]), key, j, int(place[p]), length))
    return sorted(found, key=lambda x: (x[0], x[3], x[4], x[2], str(x[1])))


MATCH = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("item_word", T.LongType()),
        T.StructField("doc_word", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ]
)


def test_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The test items in blocks of bounded size, one after another."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"] or "")
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += n
    if block:
        yield block


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The documents with ``_dc_n_words`` and ``_dc_matches``, all longest verbatim
    matches of test items that hold a window, as (item, place in the item,
    place in the document, words)."""
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUTS])
    blocks = test_blocks(benchmark, item_col, item_text_col, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return matched_with(docs, spark.sparkContext.broadcast(first), text_col, window, shard_bytes)
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(1), text_col).alias("g"), F.col(text_col).alias("t"))
    tables = []
    for block in chain([first, second], blocks):
        sent = spark.sparkContext.broadcast(block)
        part = matched_with(texts, sent, "t", window, shard_bytes).filter(F.size("_dc_matches") > 0)
        tables.append(materialize(part.select("h", "g", "_dc_matches").dropDuplicates(["h", "g"]), "decontam-matches"))
        sent.destroy()
    every = tables[0]
    for part in tables[1:]:
        every = every.union(part)
    h, g = fresh_names(docs, "_dc_h", "_dc_g")
    every = every.groupBy(F.col("h").alias(h), F.col("g").alias(g)).agg(F.flatten(F.collect_list("_dc_matches")).alias("_dc_matches"))
    every = materialize(every, "decontam-matches")
    n_bytes = every.agg(F.coalesce(F.sum(F.size("_dc_matches") * 64 + 64), F.lit(0))).first()[0]
    every = broadcast_if_small(every, n_bytes)
    on = (F.xxhash64(docs[text_col]) == every[h]) & (F.xxhash64(F.lit(1), docs[text_col]) == every[g])
    n_words = F.size(F.filter(F.split(F.coalesce(docs[text_col], F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    none = F.array().cast(T.ArrayType(MATCH))
    return docs.join(every, on, "left").select(
        *[docs[c] for c in docs.columns], n_words.cast("long").alias("_dc_n_words"), F.coalesce("_dc_matches", none).alias("_dc_matches")
    )


OUTPUTS = ("_dc_n_words", "_dc_matches", "_dc_n_hit", "_dc_contaminated")


def matched_with(docs: DataFrame, sent: Broadcast, text_col: str, window: int, shard_bytes: int) -> DataFrame:
    """The documents with their words' number and the matches of one block of items.
    A shard ends with its text bound or with the batch that Spark sends."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_dc_n_words", T.LongType()), T.StructField("_dc_matches", T.ArrayType(MATCH))])
    at = docs.columns.index(text_col)
    match = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = None
        for batch in batches:
            tests = tests or TestBlock(sent.value, window)
            for i, j in pieces_of(batch, at, shard_bytes):
                part = batch.slice(i, j - i)
                ids = [ids_of(words_of(t.as_py()), tests) for t in part.column(at)]
                matches: list[list[dict]] = [[] for _ in ids]
                for d, key, iw, dw, n in match_ids(ids, tests):
                    matches[d].append({"item": key, "item_word": iw, "doc_word": dw, "n_words": n})
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array(matches, match)], [f.name for f in schema]
                )

    return docs.mapInArrow(tidied(run), schema)


def mark(matched: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Adds ``_dc_n_hit`` (distinct words inside matches) and ``_dc_contaminated``.

    Intervals are merged by one fold over the matches in document order.
    """
    step = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("long"), m["doc_word"] + m["n_words"] - F.greatest(acc["end"], m["doc_word"]))).alias("n"),
        F.greatest(acc["end"], m["doc_word"] + m["n_words"]).alias("end"),
    )
    spans = F.array_sort(
        F.transform("_dc_matches", lambda m: F.struct(m["doc_word"].alias("doc_word"), m["n_words"].alias("n_words")))
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(spans, zero, step)["n"]
    return matched.withColumn("_dc_n_hit", hit).withColumn(
        "_dc_contaminated", (F.col("_dc_n_hit") > 0) & (F.lit(ratio) * F.col("_dc_n_hit") >= F.col("_dc_n_words"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    marked = mark(find_matches(plain, benchmark, f"c{docs.columns.index(text_col)}", **options))
    return marked.filter(~F.col("_dc_contaminated")).select(*plain.columns).toDF(*docs.columns)
