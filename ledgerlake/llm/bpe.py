"""Byte-level BPE by merge replay over a word inventory of the corpus.

Text is cut by the public pattern.  A first pass counts the distinct chunks of all
documents; the INVENTORY_CHUNKS most frequent ones (a bound that the corpus does not
move) form the corpus inventory.  The byte symbols of all its words lie in one linked
array.  An inverted
index maps every mergeable pair to the positions where it occurs.  Merges are
replayed in rank order over the whole inventory, once: all positions of the lowest
rank are merged, and only the two touched neighbours of each position are
re-indexed.  The ids of the inventory go to all workers; what is rarer or longer is
replayed in the same way by each worker, AT_ONCE words of a block of documents at a
time (smaller arrays stay in the processor's cache), and its ids
are kept up to a bound (see chunks.py).  Words do not depend on each
other, so inventories of any size give the same ids, and of all chunks only the
distinct ones of each task are shuffled.

Defined cases: null text is empty (no ids, empty bytes); very long words run
through the same index in O(n log n); an empty table gives an empty result.
Only the identifier and the text are read.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SHORT, ChunkEncoder, chunk_hashes, short_chunks
from .common import KEPT, discard, materialize, pieces_of, text_or_empty, tidied

BLOCK_BYTES = 1 << 19
AT_ONCE = 2_000
STORE_BITS = 19
INVENTORY_CHUNKS = 1 << 16
COUNTED_AT_ONCE = 1 << 19


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Encodes lists of words (bytes) by replaying merges over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pairs: dict[int, int] = {}

    def pair_rank(self, key: int) -> int:
        """Rank of the merge of the symbols key >> 20 and key & 0xFFFFF; -1 if
        they do not merge."""
        if len(self.pairs) > 100_000:
            self.pairs.clear()
        r = self.pairs[key] = self.ranks.get(self.token[key >> 20] + self.token[key & 0xFFFFF], -1)
        return r

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        open_words = []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = [r]
            elif not w:
                out[i] = []
            else:
                open_words.append(i)
        if open_words:
            for i, ids in zip(open_words, self._replay([words[i] for i in open_words])):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> Iterator[list[int]]:
        joined = np.frombuffer(b"".join(words), dtype=np.uint8)
        n = len(joined)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        starts = (ends - lengths).tolist()
        first = np.array(self.byte_id)[joined]
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[starts] = -1
        sym, nxt, prv = first.tolist(), after.tolist(), before.tolist()
        # the inverted index of the byte pairs, from one sort
        ranks = self.byte_pairs[joined[:-1], joined[1:]]
        at = np.flatnonzero((ranks >= 0) & (after[:-1] >= 0))
        at = at[np.argsort(ranks[at], kind="stable")]
        values, cuts = np.unique(ranks[at], return_index=True)
        index = {r: part.tolist() for r, part in zip(values.tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        heap = list(index)
        heapq.heapify(heap)
        early: set[int] = set()
        pairs, learn = self.pairs, self.pair_rank
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for p in positions:
                a = sym[p]
                if a < 0:
                    continue
                q = nxt[p]
                if q < 0:
                    continue
                key = a << 20 | sym[q]
                r = pairs.get(key)
                if (learn(key) if r is None else r) != rank:
                    continue
                sym[p], sym[q] = rank, -1
                q = nxt[p] = nxt[q]
                if q >= 0:
                    prv[q] = p
                    key = rank << 20 | sym[q]
                    r = pairs.get(key)
                    if r is None:
                        r = learn(key)
                    if r >= 0:
                        if r < rank:
                            early.add(p)
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heapq.heappush(heap, r)
                q = prv[p]
                if q >= 0:
                    key = sym[q] << 20 | rank
                    r = pairs.get(key)
                    if r is None:
                        r = learn(key)
                    if r >= 0:
                        if r < rank:
                            early.add(q)
                        if r in index:
                            index[r].append(q)
                        else:
                            index[r] = [q]
                            heapq.heappush(heap, r)
        redo = set(np.searchsorted(starts, sorted(early), side="right") - 1) if early else ()
        for i, s in enumerate(starts):
            if i in redo:  # a merge made a pair of a lower rank: order inside the word matters
                yield self.encode_one(words[i])
                continue
            ids, p = [], s
            while p >= 0:
                ids.append(sym[p])
                p = nxt[p]
            yield ids

    def encode_one(self, word: bytes) -> list[int]:
        """One word alone: merge the leftmost lowest pair until none is left."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        sym, nxt, prv = [self.byte_id[b] for b in word], [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, p, sym[p], sym[p + 1]) for p in range(n - 1) if (r := self.pair_rank(sym[p] << 20 | sym[p + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, p, a, b = heapq.heappop(heap)
            q = nxt[p] if sym[p] == a else -1
            if q < 0 or sym[q] != b:
                continue
            sym[p], sym[q] = r, -1
            nxt[p] = nxt[q]
            if nxt[p] >= 0:
                prv[nxt[p]] = p
            for x, y in ((prv[p], p), (p, nxt[p])):
                if x >= 0 and y >= 0 and (k := self.pair_rank(sym[x] << 20 | sym[y])) >= 0:
                    heapq.heappush(heap, (k, x, sym[x], sym[y]))
        return [s for s in sym if s >= 0]


class ReplayEncoder(ChunkEncoder):
    """Chunks are cut by the pattern; their words are replayed together, so many at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, bits: int = STORE_BITS):
        super().__init__(pattern, bits)
        self.replay = MergeReplay(ranks)
        self.loaded = ""

    def load(self, token: str, inventory: pa.Table) -> None:
        """Puts the ids of an inventory into the store, to stay there."""
        if self.loaded == token:
            return
        self.store.kept = None
        self.store.clear()
        data = b"".join(chunks := inventory.column("chunk").to_pylist())
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        parts = short_chunks(np.frombuffer(data, dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)
        h, first = np.unique(chunk_hashes(parts, sizes), return_index=True)
        ids = inventory.column("ids").to_pylist()
        if len(h):
            self.store.add(h, parts[first], sizes[first], [ids[i] for i in first])
        self.store.keep()
        self.loaded = token

    def fresh(self, chunks: list[str], at_once: int = AT_ONCE) -> list[list[int]]:
        cut = [self.split(c) for c in chunks]
        words = list(set(chain.from_iterable(cut)))
        ids: dict[str, list[int]] = {}
        for k in range(0, len(words), at_once):
            part = words[k : k + at_once]
            ids.update(zip(part, self.replay.encode_words([w.encode("utf-8", "surrogatepass") for w in part])))
        return [ids[c[0]] if len(c) == 1 else [i for w in c for i in ids[w]] for c in cut]


@lru_cache(maxsize=1)
def replay_encoder(ranks_path: str, pattern: str) -> ReplayEncoder:
    """One encoder a worker process: its memory serves task after task."""
    return ReplayEncoder(load_ranks(ranks_path), pattern)


KEPT["bpe"] = replay_encoder.cache_clear


class ChunkCounts:
    """Distinct short chunks of texts with their counts, given away in tables of a
    bounded size."""

    def __init__(self, pattern: str):
        self.encoder = ChunkEncoder(pattern, bits=1)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, texts: pa.Array) -> None:
        _, b, starts, _ = self.encoder.chunks_of(texts)
        sizes = np.diff(np.append(starts, len(b)))
        short = np.flatnonzero(sizes <= SHORT)
        starts, sizes = starts[short], sizes[short]
        parts = short_chunks(b, starts, sizes)
        h, first, n = np.unique(chunk_hashes(parts, sizes), return_index=True, return_counts=True)
        self.held.append((h, parts[first], sizes[first], n))
        self.n += len(h)
        if self.n > COUNTED_AT_ONCE:
            self.merge()

    def merge(self) -> None:
        h, parts, sizes, n = (np.concatenate(x) for x in zip(*self.held))
        h, first, same = np.unique(h, return_index=True, return_inverse=True)
        self.held = [(h, parts[first], sizes[first], np.bincount(same, weights=n).astype(np.int64))]
        self.n = len(h)

    def tables(self, all_: bool) -> Iterator[pa.RecordBatch]:
        """The counts, if they are asked for or have grown beyond the bound."""
        if not self.held or not (all_ or self.n > COUNTED_AT_ONCE // 2):
            return
        self.merge()
        _, parts, sizes, n = self.held[0]
        self.held, self.n = [], 0
        raw = parts.view(np.uint8).reshape(len(parts), SHORT)[np.arange(SHORT) < sizes[:, None]]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
        yield pa.RecordBatch.from_arrays([chunks, pa.array(n)], ["chunk", "n"])


def corpus_inventory(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", most: int | None = None) -> pa.Table:
    """(chunk, ids) of the most frequent chunks of the corpus, at most so many: those
    of the counts above which no more than that remain, by a table of counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = ChunkCounts(pattern)
        for batch in batches:
            for i, j in pieces_of(batch, 0, BLOCK_BYTES):
                seen.add(batch.column(0).slice(i, j - i))
                yield from seen.tables(False)
        yield from seen.tables(True)

    most = INVENTORY_CHUNKS if most is None else most
    counted = docs.select(text_or_empty(text_col).alias("_text")).mapInArrow(tidied(count, "bpe"), "chunk binary, n long")
    counts = materialize(counted.groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1"), "bpe-chunks")
    level = F.floor(F.log2("n") * 8)
    least, held = 1 << 30, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundreds at most
        held += r["count"]
        if held > most:
            break
        least = r["level"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replay_encoder(ranks_path, pattern)
        chunks = [c for batch in batches for c in batch.column(0).to_pylist()]  # INVENTORY_CHUNKS of SHORT bytes at most
        ids = coder.fresh([c.decode("utf-8", "surrogatepass") for c in chunks], max(1, len(chunks)))
        for k in range(0, len(chunks), AT_ONCE):
            part = pa.array(chunks[k : k + AT_ONCE], pa.binary()), pa.array(ids[k : k + AT_ONCE], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(part), ["chunk", "ids"])

    chosen = counts.filter(level >= least).select("chunk").repartition(1)
    out = chosen.mapInArrow(tidied(replay, "bpe"), "chunk binary, ids array<int>").toArrow()
    discard(counts)
    return out


def bpe_round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, ids array<int>, decoded binary: every text encoded, and decoded from its ids."""
    src = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    id_type = src.schema["_id"].dataType
    sent = docs.sparkSession.sparkContext.broadcast(corpus_inventory(docs, ranks_path, pattern, text_col))
    made = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            if coder is None:
                coder = replay_encoder(ranks_path, pattern)
                coder.load(made, sent.value)
                token = coder.replay.token
            for i, j in pieces_of(batch, 1, BLOCK_BYTES):
                flat, sizes = coder.encode(batch.column(1).slice(i, j - i))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int32)))
                listed = flat.tolist()
                decoded = [b"".join(map(token.__getitem__, listed[a:b])) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), ids, pa.array(decoded, pa.binary())], ["_id", "ids", "decoded"]
                )

    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    schema = StructType(
        [StructField("_id", id_type), StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]
    )
    return src.mapInArrow(tidied(run, "bpe"), schema).withColumnRenamed("_id", id_col)


def decode_ids(token: dict[int, bytes], ids: list[int]) -> bytes:
    return b"".join(map(token.__getitem__, ids))


__all__ = ["MergeReplay", "ReplayEncoder", "bpe_round_trip", "decode_ids", "load_ranks"]
