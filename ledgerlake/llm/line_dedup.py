"""Line deduplication by an exact set-similarity join with prefix, positional
and length filters.

A line is the set of its words.  A later line goes if an earlier line of the
corpus, in the order of (identifier, text hash, line number), has a Jaccard
similarity of at least the threshold.  The steps:

1. A frequency sketch over all words of all texts: SKETCH counters, summed over
   the corpus.  It fits any cluster (a fixed 2 MB) and gives one global rarity
   order: counter first, then hash.  Any global order is exact for prefix
   filters; a good one makes the lists short.
2. Lines with equal word sets form a class, represented by its first line, so
   copies are never paired.  Each class has its size, a parity bitmap (128 bits or more) and
   the keys of its prefix (the rarest words, enough that two similar lines share
   one).  A word above HOT occurrences is no key by itself; it gives a key with
   each of the next GAP words.  Two similar lines differ in at most D words, so of
   D // GAP + 1 neighbouring pairs of shared words at least one has fewer than GAP
   other words between it in both lines; the prefix is longer by that many places.
   The keys so are at most GAP for each place, however long the line and however common its words.
3. Classes are dealt out by key, sorted by size, and paired within the length
   filter; positional filter and the parity bitmap (a lower bound on the
   symmetric difference) drop almost all false pairs before any row is made.
   A line that already has SURE likely partners is not paired further here.
   A key of more than GROUP rows (estimated on a fixed share of the classes) is
   salted into groups of about that size.
4. Pairs are verified on the words themselves.  Lines whose likely partners all
   failed and who had more possible ones, or who met only a part of a salted key,
   are paired again without that stop and sent to every part of such a key, so
   no similar line is lost and large groups of variants stay linear.
5. Removed lines are gathered per document and cut out of the text.

Defined cases: words are maximal runs of letters, digits and non-ASCII after
lower-casing A-Z; a line without words is never removed; null text stays null;
rows that share identifier and text are one document (all get the same answer);
identifiers of any type that can be ordered, numbers of any size and strings
(by bytes) included; a null identifier comes first; an empty table gives an
empty result.  Working columns take names that the input does not have; an input
column called like an output column (``_ld_lines``, ``_ld_removed``) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, fresh_names, materialize, pieces_of, tidied
from .wordhash import WORDS, hash_words

NUM, DEN = 4, 5  # the threshold 0.8
SKETCH_BITS = 18
PART_BITS = 10  # counters in one row of a sketch under way
HOT = 2048
GAP = 64
SURE = 2
GROUP = 100_000
LOOKED_AT = 64  # one class of so many is looked at to find the keys beyond GROUP
BLOCK_BYTES = 2 << 20
PAIRS_AT_ONCE = 200_000
PARITY_SIZES = (100, 220, 500)  # more words: 256, 512, 1024 bits
LEVELS = 1 << 17
HASH_BITS = 46
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[k]
    return x ^ (x >> np.uint64(29))


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with first[i] <= j < last[i]."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]


def word_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The sketch: summed counts of words by the top bits of their hash.

    Sketches travel in parts, each with its places and counts that are not zero;
    the parts of one place meet in one task, which holds one sum at a time."""
    width = 1 << PART_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for i, j in pieces_of(batch, 0, BLOCK_BYTES):
                data = "\n".join(t for t in batch.column(0).slice(i, j - i).to_pylist() if t)
                hashes, _ = hash_words(data.encode("utf-8", "surrogatepass").translate(WORDS))
                total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        parts = total.reshape(-1, width)
        used = np.flatnonzero(parts.any(axis=1))
        at = [np.flatnonzero(parts[k]).astype(np.int16) for k in used]
        counts = [parts[k][i].tobytes() for k, i in zip(used, at)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([i.tobytes() for i in at], pa.binary()), pa.array(counts, pa.binary())], ["part", "at", "n"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = -1, np.zeros(width, dtype=np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "n"])

        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != part:
                    if part >= 0:
                        yield done()
                    part, total = k, np.zeros(width, dtype=np.int64)
                total[np.frombuffer(at, dtype=np.int16)] += np.frombuffer(n, dtype=np.int64)
        if part >= 0:
            yield done()

    counted = docs.select(text).mapInArrow(tidied(count), "part long, at binary, n binary")
    summed = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, n binary").toArrow()
    out = np.zeros((1 << SKETCH_BITS - PART_BITS, width), dtype=np.int64)
    for part, n in zip(summed.column("part").to_pylist(), summed.column("n").to_pylist()):
        out[part] = np.frombuffer(n, dtype=np.int64)
    return out.reshape(-1)


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)) * 1024, LEVELS - 1).astype(np.uint32)


def line_sets(data: bytes, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, words, keys, hashes) of the lines with words of a translated text:
    line numbers and numbers of distinct words, and, line by line, the words'
    keys (rarity level, then hash) in rising order, and their hashes."""
    hashes, starts = hash_words(data)
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    line = np.searchsorted(ends, starts).astype(np.uint64)
    level = levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    short = np.uint64(HASH_BITS - 14)
    low = hashes & np.uint64((1 << HASH_BITS) - 1)
    if len(ends) < 1 << 15:
        order = np.argsort((line << np.uint64(49)) | (level << short) | (low >> np.uint64(14)), kind="quicksort")
    else:  # very many very short lines
        order = np.lexsort((low, level, line))
    line, low, level, hashes = line[order], low[order], level[order], hashes[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    line, low, level, hashes = line[new], low[new], level[new], hashes[new]
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(begin, len(line)))
    return line[begin].astype(np.int64), sizes, ((level << np.uint64(HASH_BITS)) | low).astype(np.int64), hashes


def parity_level(size: np.ndarray) -> np.ndarray:
    """Parity bitmaps have 128 bits << level: longer lines need more."""
    return np.searchsorted(PARITY_SIZES, size, side="right")


def parities(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Per line the parity of its words in each bit, by hash."""
    words = 2 << parity_level(sizes)
    begin = np.cumsum(words) - words
    no, at = ranges(starts, starts + sizes)
    bit = mixed(hashes[at], 2) >> np.uint64(54) & (64 * words - 1).astype(np.uint64)[no]
    bits = np.zeros(int(words.sum()), dtype=np.uint64)
    np.bitwise_xor.at(bits, begin[no] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    ends = (8 * np.append(begin, len(bits))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(bits)])


class Parities:
    """Parity bitmaps of many lines, to be compared at the smaller size of two:
    a bitmap folds to half its bits by exclusive or."""

    def __init__(self, raw: pa.Array):
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) // 8
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint64, count=int(ends[-1]))
        self.level = np.log2(np.diff(ends) // 2).astype(np.int64)
        self.bits = []
        for k in range(int(self.level.max(initial=0)) + 1):
            words = 2 << k
            m = np.zeros((len(raw), words), dtype=np.uint64)
            for j in range(k, int(self.level.max(initial=0)) + 1):
                own = np.flatnonzero(self.level == j)
                full = data[ends[own, None] + np.arange(2 << j)].reshape(len(own), 1 << (j - k), words)
                m[own] = full[:, 0] if j == k else np.bitwise_xor.reduce(full, axis=1)
            self.bits.append(m)

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.minimum(self.level[i], self.level[j])
        out = np.zeros(len(i), dtype=np.int64)
        for k, m in enumerate(self.bits):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.bitwise_count(m[i[at]] ^ m[j[at]]).sum(axis=1, dtype=np.int64)
        return out


def prefix_keys(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places and line numbers of all prefixes; flat holds the sorted word
    keys of the lines, from starts on, sizes long."""
    least = -(-NUM * sizes // DEN)
    n = sizes - least + 1
    n[(least == sizes) & (DEN * sizes // NUM == sizes)] = 0  # only equal sets are similar
    differ = (sizes + DEN * sizes // NUM) // (DEN + NUM)  # words that two similar lines may not share
    more = differ // GAP + 1
    reach = np.where(n > 0, np.minimum(n + more, sizes), 0)
    line = np.repeat(np.arange(len(sizes)), reach)
    place = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    at = starts[line] + place
    word = flat[at]
    hot = (word >> HASH_BITS) >= int(np.log2(HOT) * 1024)
    single = ~hot & (place < n[line])
    keys, places, lines = [mixed(word[single].astype(np.uint64), 0)], [place[single]], [line[single]]
    h_at, h_place, h_line = at[hot], place[hot], line[hot]
    for step in range(1, GAP + 1):
        ok = h_place + step < reach[h_line]
        h_at, h_place, h_line = h_at[ok], h_place[ok], h_line[ok]
        if not len(h_at):
            break
        both = mixed(flat[h_at].astype(np.uint64), 1) + flat[h_at + step].astype(np.uint64)
        keys.append(mixed(both, 2)), places.append(np.where(more[h_line] > 1, 0, h_place)), lines.append(h_line)
    lines = np.concatenate(lines)
    order = np.argsort(lines, kind="stable")
    return np.concatenate(keys)[order], np.concatenate(places)[order], lines[order]


def line_table(docs: DataFrame, counts: np.ndarray, id_col: str, text: str) -> DataFrame:
    """One row per line with words: document, line, class, size, parity, keys.

    A worker sends the keys of a class once per block of documents.
    """
    levels = docs.sparkSession.sparkContext.broadcast(rarity_levels(counts))
    src = docs.select(F.col(id_col).alias("d"), text_hash(text).alias("h"), F.col(text).alias("t"))
    schema = T.StructType(
        [
            T.StructField("d", src.schema["d"].dataType),
            T.StructField("h", T.LongType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("c1", T.LongType()),
            T.StructField("c2", T.LongType()),
            T.StructField("size", T.IntegerType()),
            T.StructField("parity", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
            T.StructField("places", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces_of(batch, 2, BLOCK_BYTES):
                texts = [(t or "").encode("utf-8", "surrogatepass").translate(WORDS) for t in batch.column(2).slice(i, j - i).to_pylist()]
                number, n, f, hashes = line_sets(b"\n".join(texts), levels.value)
                if not len(number):
                    continue
                first_line = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
                rows = np.searchsorted(first_line, number, side="right") - 1
                starts = np.cumsum(n) - n
                c1, c2 = (np.add.reduceat(mixed(hashes + MIX[2], k), starts).astype(np.int64) for k in (0, 1))
                keys, places, lines = prefix_keys(f, starts, n)
                ends = np.searchsorted(lines, np.arange(len(n) + 1)).astype(np.int32)
                part = [batch.column(c).slice(i, j - i).take(pa.array(rows)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part,
                        pa.array((number - first_line[rows]).astype(np.int32)),
                        pa.array(c1),
                        pa.array(c2),
                        pa.array(n.astype(np.int32)),
                        parities(hashes, starts, n),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(places.astype(np.int32))),
                    ],
                    [x.name for x in schema],
                )

    return src.mapInArrow(tidied(run), schema)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text))


def pairs_of(key, size, place, parity: Parities, order, limit, sought):
    """Likely pairs among rows sorted by (key, size): (later, earlier, distance of
    the parity bitmaps), and the rows whose pairing may have stopped early.

    order ranks the lines of the corpus; sought are the rows that need partners;
    limit is the number of likely partners after which a row stops.
    """
    n = len(key)
    at = np.arange(n)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    g_start = np.flatnonzero(new)
    # lengths: sizes are sorted in a group, so partners form one range
    span = int(size.max()) + 1
    flat = group * span + size
    lo = np.maximum(np.searchsorted(flat, group * span + -(-NUM * size // DEN)), g_start[group])
    hi = np.searchsorted(flat, group * span + np.minimum(DEN * size // NUM, span - 1), side="right")
    found = np.zeros(n, dtype=np.int64)
    later_out, earlier_out, distance_out = [], [], []

    def test(i, j):
        ok = order[i] > order[j]
        i, j = np.where(ok, i, j), np.where(ok, j, i)
        both = size[i] + size[j]
        slack = both - 2 * -(-NUM * both // (NUM + DEN))
        ok = sought[i] & (place[i] + place[j] <= slack)
        i, j, slack = i[ok], j[ok], slack[ok]
        distance = parity.distance(i, j)
        ok = distance <= slack
        i, j = i[ok], j[ok]
        later_out.append(i), earlier_out.append(j), distance_out.append(distance[ok])
        np.add.at(found, i, 1)

    def sweep(rows, first, last):
        total = np.cumsum(np.maximum(last - first, 0))
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
            i, j = ranges(first[a:b], last[a:b])
            if len(i):
                test(rows[a:b][i], j)
            a = b

    near = 256
    sweep(at, at + 1, np.minimum(hi, at + 1 + near))
    left = at[(found < limit) & sought & ((hi - at - 1 > near) | (at - lo > near))]
    sweep(left, lo[left], np.maximum(lo[left], left - near))
    sweep(left, np.minimum(hi[left], left + 1 + near), hi[left])
    stopped = sought & (found >= limit)
    joined = lambda parts: np.concatenate([at[:0], *parts])
    return joined(later_out), joined(earlier_out), joined(distance_out), stopped


LINE = ["d", "h", "line"]
EARLIER = ["e_d", "e_h", "e_line"]


def corpus_order(t: pa.Table) -> np.ndarray:
    """Numbers that order the rows by LINE, equal for one line."""
    d = pc.rank(t.column("d"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    h, line = t.column("h").to_numpy(), t.column("line").to_numpy()
    one = np.zeros(len(d) + 1, dtype=np.int64)
    one[d] = h
    if (one[d] == h).all():  # the identifier alone tells the document
        return (d << 32) | line
    o = np.lexsort((line, h, d))
    step = (np.diff(d[o]) != 0) | (np.diff(h[o]) != 0) | (np.diff(line[o]) != 0)
    order = np.empty(len(o), dtype=np.int64)
    order[o] = np.concatenate([[0], np.cumsum(step)])
    return order


def likely_pairs(postings: DataFrame, limit: int = SURE) -> DataFrame:
    """(LINE of the later line, EARLIER, more): at most limit partners a row and
    key; more says that there may be others.  Without a column sought all rows are."""
    marked = "sought" in postings.columns
    kind = postings.schema["d"].dataType
    fields = [T.StructField("d", kind), T.StructField("h", T.LongType()), T.StructField("line", T.IntegerType())]
    schema = T.StructType([*fields, *(T.StructField("e_" + f.name, f.dataType) for f in fields), T.StructField("more", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda c: t.column(c).to_numpy()
            same = np.diff(col("key"), prepend=0, append=0) == 0
            same[[0, -1]] = False
            met = np.flatnonzero(same[1:] | same[:-1])  # keys of one row have no pairs
            if not len(met):
                return
            size = col("measure")[met] >> 32
            group = np.cumsum(np.diff(col("key")[met], prepend=0) != 0)
            t = t.take(pa.array(met[np.argsort((group << 32) | size, kind="stable")]))
            order = corpus_order(t)
            measure = col("measure")
            later, earlier, distance, stopped = pairs_of(
                col("key"),
                measure >> 32,
                measure & 0xFFFFFFFF,
                Parities(t.column("parity").combine_chunks()),
                order,
                limit,
                col("sought").astype(bool) if marked else np.ones(t.num_rows, dtype=bool),
            )
            if not len(later):
                return
            # of each later row the limit nearest partners
            o = np.lexsort((order[earlier], distance, later))
            later, earlier = later[o], earlier[o]
            begin = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
            number = np.arange(len(later)) - np.repeat(begin, np.diff([*begin, len(later)]))
            keep = number < limit
            later, earlier = later[keep], earlier[keep]
            ids = t.select(LINE).combine_chunks()
            named = [ids.take(pa.array(k)).column(c).combine_chunks() for k in (later, earlier) for c in LINE]
            yield pa.RecordBatch.from_arrays([*named, pa.array(stopped[later])], [f.name for f in schema])

        rows, enough = 0, 100_000
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from work(t.slice(0, cut))
                t = t.slice(cut)
            held, rows = t.to_batches(), t.num_rows
            enough = max(100_000, 2 * rows)  # a large group is looked at rarely
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt = postings.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(run), schema)


def same_line(left: DataFrame, right: DataFrame, names: list[str] = LINE, others: list[str] = LINE) -> Column:
    d, h, line = ((left[a], right[b]) for a, b in zip(names, others))
    return d[0].eqNullSafe(d[1]) & (h[0] == h[1]) & (line[0] == line[1])


def large_keys(classes: DataFrame) -> DataFrame | None:
    """(key, parts) of the keys with more than GROUP rows, as seen in a fixed share
    of the classes; None if there are none.  What the estimate misses is only held
    in larger groups."""
    seen = classes.filter(F.pmod(F.xxhash64("h", "line"), F.lit(LOOKED_AT)) == 0).select(F.explode("keys").alias("key"))
    n = F.col("count") * LOOKED_AT
    counts = seen.groupBy("key").count().filter(n > GROUP).select("key", F.ceil(n / GROUP).cast("int").alias("parts"))
    counts = materialize(counts, "line-large-keys")
    n_keys = counts.count()
    return broadcast_if_small(counts, 32 * n_keys) if n_keys else None


def words_column(line: Column) -> Column:
    """The distinct words of a line, as the sketch and the line table see them."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = F.split(F.translate(line, upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_distinct(F.filter(cut, lambda w: w != ""))


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The pairs whose word sets have the similarity, on the words themselves.

    The lines sought are joined to the documents by a broadcast while their
    measured size allows it, so that texts need not be shuffled."""
    ids = pairs.select(*LINE).union(pairs.select(*EARLIER)).distinct()
    by_doc = materialize(ids.groupBy("d", "h").agg(F.collect_list("line").alias("sought")), "lines-sought")
    n_bytes = by_doc.agg(F.coalesce(F.sum(F.size("sought") * 8 + 64), F.lit(0))).first()[0]
    by_doc = broadcast_if_small(by_doc, n_bytes)
    src = docs.select(F.col(id_col).alias("sd"), text_hash(text).alias("sh"), F.col(text).alias("t"))
    lines = (
        src.join(by_doc, src["sd"].eqNullSafe(by_doc["d"]) & (src["sh"] == by_doc["h"]))
        .select("d", "h", "sought", F.split("t", "\n").alias("lines"))
        .select("d", "h", F.explode(F.transform("sought", lambda k: F.struct(k.alias("line"), F.get("lines", k).alias("l")))).alias("x"))
        .groupBy("d", "h", "x.line")
        .agg(F.first("x.l").alias("l"))
        .select(*LINE, words_column(F.col("l")).alias("w"))
    )
    lines = materialize(lines, "lines-words")
    early = lines.select(*[F.col(a).alias(b) for a, b in zip(LINE, EARLIER)], F.col("w").alias("v"))
    both = F.size(F.array_intersect("w", "v"))
    left = pairs.join(lines, same_line(pairs, lines)).select(*[pairs[c] for c in (*LINE, *EARLIER)], "w")
    return (
        left.join(early, same_line(left, early, EARLIER, EARLIER))
        .select(*[left[c] for c in (*LINE, *EARLIER)], "w", "v")
        .filter(F.lit(DEN) * both >= F.lit(NUM) * (F.size("w") + F.size("v") - both))
        .select(*LINE, *EARLIER)
    )


def postings_of(classes: DataFrame) -> DataFrame:
    """One row a key: the line, its size and the key's place as one number, and more."""
    keyed = F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place")))
    rest = [c for c in classes.columns if c in (*LINE, "parity", "sought")]
    rows = classes.select(*rest, keyed, F.shiftleft(F.col("size").cast("long"), 32).alias("wide"))
    return rows.select(*rest, "key", F.col("wide").bitwiseOR(F.col("place").cast("long")).alias("measure"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, lines): per document with removed lines their numbers, from 0.

    Copies of a class's first line are removed lines at once, so what is left to
    pair are first lines, known by identifier, text hash and line number."""
    lines = materialize(line_table(docs, word_frequencies(docs, text_col), id_col, text_col), "lines")
    place = F.struct(*map(F.col, LINE))
    first = F.min(F.struct(place.alias("p"), *map(F.col, ("size", "parity", "keys", "places")))).alias("m")
    classes = materialize(
        lines.groupBy("c1", "c2")
        .agg(first, F.count(F.lit(1)).alias("n"))
        .select("c1", "c2", "n", "m.p.d", "m.p.h", "m.p.line", "m.size", "m.parity", "m.keys", "m.places"),
        "line-classes",
    )
    several = classes.filter("n > 1").select("c1", "c2", *[F.col(a).alias(b) for a, b in zip(LINE, EARLIER)])
    several = broadcast_if_small(several, 64 * several.count())
    members = lines.select("c1", "c2", *LINE).join(several, ["c1", "c2"])
    copies = materialize(members.filter(~same_line(members, members, LINE, EARLIER)).select(*LINE), "line-copies")
    discard(lines)
    large = large_keys(classes)
    postings = postings_of(classes)
    part = F.pmod(F.xxhash64("h", "line"), F.col("parts"))
    salted = lambda p: F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", p)).alias("key")
    shown = [*LINE, "parity", "measure"]
    own = postings if large is None else postings.join(large, "key", "left").select(*shown, salted(part))
    found = materialize(likely_pairs(own).groupBy(*LINE, *EARLIER).agg(F.max("more").alias("more")), "line-pairs")
    good = materialize(verified(found, docs, id_col, text_col).select(*LINE).distinct(), "line-verified")
    open_ = found.filter("more").select(*LINE)
    if large is not None:
        open_ = open_.union(postings.join(large, "key", "left_semi").select(*LINE))
    open_ = open_.distinct()
    open_ = materialize(open_.join(good, same_line(open_, good), "left_anti").withColumn("sought", F.lit(True)), "line-open")
    n_open = open_.count()
    if n_open:
        small = broadcast_if_small(open_, 64 * n_open)
        # only rows that may be partners of an open line are dealt out again: by key, size, place in the prefix and order
        size, place, line = F.shiftright("measure", 32), F.col("measure").bitwiseAND(F.lit((1 << 32) - 1)), F.struct(*LINE)
        seeking = postings_of(classes.join(small, same_line(classes, small), "left_semi"))
        keys = seeking.groupBy("key").agg(F.min(size).alias("least"), F.max(size).alias("most"), F.min(place).alias("place"), F.max(line).alias("last"))
        keys = materialize(keys, "line-keys")
        n_keys = keys.count()
        marked = classes.join(small, same_line(classes, small), "left").select(
            *[classes[c] for c in (*LINE, "size", "parity", "keys", "places")], F.coalesce("sought", F.lit(False)).alias("sought")
        )
        again = postings_of(marked)
        fits = (F.lit(DEN) * size >= F.lit(NUM) * F.col("least")) & (F.lit(NUM) * size <= F.lit(DEN) * F.col("most"))
        fits &= (F.lit(NUM + DEN) * (place + F.col("place")) <= F.col("most") + size) & (line <= F.col("last"))
        within = (again["key"] == keys["key"]) & (F.col("sought") | fits)
        again = again.join(broadcast_if_small(keys, 128 * n_keys), within, "left_semi")
        if large is not None:
            every = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).when(
                F.col("sought"), F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
            )
            again = again.join(large, "key", "left").withColumn("part", F.explode(F.coalesce(every, F.array(part.cast("long")))))
            again = again.select(*shown, "sought", salted(F.col("part")))
        rest = likely_pairs(again, 1 << 40).select(*LINE, *EARLIER).distinct()
        rest = rest.join(found, same_line(rest, found) & same_line(rest, found, EARLIER, EARLIER), "left_anti")
        rest = verified(materialize(rest, "line-rest"), docs, id_col, text_col).select(*LINE)
        good = materialize(good.union(rest).distinct(), "line-beaten")
    discard(classes, found)
    out = materialize(copies.union(good).groupBy("d", "h").agg(F.collect_set("line").alias("lines")), "lines-gone")
    discard(copies, good)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, with the text without removed lines,
    and ``_ld_lines`` and ``_ld_removed``, the numbers of lines before and removed."""
    d, h, cut = fresh_names(docs, "_ld_d", "_ld_h", "_ld_gone")
    gone = removed_lines(docs, id_col, text_col).select(F.col("d").alias(d), F.col("h").alias(h), F.col("lines").alias(cut))
    n_bytes = gone.agg(F.coalesce(F.sum(F.size(cut) * 4 + 64), F.lit(0))).first()[0]
    gone = broadcast_if_small(gone, n_bytes)
    on = docs[id_col].eqNullSafe(gone[d]) & (F.xxhash64(docs[text_col]) == gone[h])
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(cut, i))
    text = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_gone = F.coalesce(F.size(cut), F.lit(0))
    counts = {
        "_ld_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text_col), "\n"))),
        "_ld_removed": F.greatest(n_gone, F.lit(0)),
    }
    return docs.join(gone, on, "left").select(
        *[(text if c == text_col else docs[c]).alias(c) for c in docs.columns if c not in counts],
        *[n.cast("long").alias(c) for c, n in counts.items()],
    )
