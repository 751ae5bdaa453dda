"""Near-duplicate groups by BagMinHash signatures, banding and verification.

A document is the bag of its shingles of five words.  BagMinHash gives each bag
M components whose chance to agree is the weighted Jaccard similarity: weights
are discretised at the integers, and the levels [0, 1), [1, 2), [2, 4), [4, 8)...
are independent Poisson processes of points, seeded by the shingle and the level,
each point at a time and in a random component.  All points of a level that lies
wholly below the weight count; in the level that contains the weight a point is
split off by its own position.  A component is the earliest time in it.  Points
later than the last component filled change nothing, so a document looks at
about M ln M points however long it is; a bound on time that leaves components
empty is doubled for that document.

Documents with equal word sequences form a class (copies are never paired).  The
signature is cut into BANDS bands; classes that agree in a band are candidates if
their total weights allow the similarity and four-bit sketches of the signatures
are near enough (3.5 standard deviations beyond the threshold).  Candidates are
verified on the bags themselves.  A band value of more than GROUP
rows is salted into parts of about that size.  Pairing is in rounds: first a row is held
against its likeliest partner, verified, and components are built; then
each row outside the commonest component of a band value is held against all rows
of other components there: first its nearest is verified, which joins most, then
whatever is left untried.  So a group of many variants costs about a linear number
of pairs, and no candidate link between two components is lost.  In a salted value
its LEADERS go to all parts in the first round, and later each row outside the
commonest component of the whole value does, so that it meets all others there.

Defined cases: words are maximal runs of letters, digits and non-ASCII after
lower-casing A-Z; a text of one to four words is one shingle; a text without
words is alone, unless its text is exactly empty or null like others, which also
stay alone; rows of equal identifier and text are members of one group; null
identifiers keep null only where a group has no other; an empty table gives an
empty result.  Working columns are kept apart from the input's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, materialize, pieces_of, tidied
from .line_dedup import ranges
from .wordhash import WORDS, hash_words, mixed

SHINGLE = 5
NUM, DEN = 4, 5  # the threshold 0.8
M, BANDS, ROWS = 256, 32, 4
BLOCK_BYTES = 1 << 20
KNOWN_SHINGLES = 60_000
PAIRS_AT_ONCE = 300_000
#: Sketches hold four bits of each component; those of similar bags differ in
#: 15 / 16 * (1 - J) * M components: 48 at J = 0.8, and 70 is 3.5 deviations more.
MAX_FAR = 70
SURE_FAR = 42
NIBBLES = np.uint64(0x1111111111111111)
LEADERS, NEAR = 4, 16
GROUP = 50_000
B, C = np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def shingles_of(words: list[bytes], size: int = SHINGLE) -> Counter:
    if not words:
        return Counter()
    if len(words) < size:
        return Counter([tuple(words)])
    return Counter(zip(*(words[k:] for k in range(size))))


def bags(word_hashes: np.ndarray, n_words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of the shingles of consecutive documents."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(doc))
    h = np.zeros(len(doc), dtype=np.uint64)
    for k in range(size):
        part = np.zeros(len(doc), dtype=np.uint64)
        part[: len(doc) - k] = word_hashes[k:]
        part[left <= k] = 0
        h = mixed(h * C + part + np.uint64(k + 1))
    first = left == np.repeat(n_words, n_words)
    ok = (left >= size) | (first & (left < size))
    doc, h = doc[ok], h[ok]
    element = (doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    element.sort()
    begin = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, dtype=np.int64)
    weight = np.diff(np.append(begin, len(element)))
    element = element[begin]
    return (element >> np.uint64(44)).astype(np.int64), element & np.uint64((1 << 44) - 1), weight


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """Signatures (n_docs, m) of times; infinite for documents without elements."""
    sig = np.full((n_docs, m), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    bound = m * (np.log(m) + 2) / np.maximum(total, 1e-9)
    todo = np.ones(len(doc), dtype=bool)
    while todo.any():
        d0, e0, w0 = doc[todo], element[todo], weight[todo]
        level, low, rate = 0, 0, 1.0
        while True:
            on = w0 > low
            if not on.any():
                break
            d, e, w = d0[on], e0[on], w0[on]
            state = mixed(e * C + np.uint64(2 * level + 1))
            time = np.zeros(len(d))
            last = bound[d]
            while len(d):
                state = mixed(state + C)
                time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
                ok = time <= last
                d, w, state, time, last = d[ok], w[ok], state[ok], time[ok], last[ok]
                if not len(d):
                    break
                place = mixed(state ^ B)
                component = (place & np.uint64(m - 1)).astype(np.int64)
                value = low + rate * ((place >> np.uint64(11)).astype(np.float64) * 2.0**-53) if level else np.zeros(len(d))
                in_ = value < w
                np.minimum.at(sig.reshape(-1), d[in_] * m + component[in_], time[in_])
            level, low, rate = level + 1, (1 << level), float(1 << level)
        open_ = np.isinf(sig).any(axis=1) & (total > 0)
        bound = np.where(open_, bound * 2, bound)
        todo = open_[doc]
    return sig


def sketches(bits: np.ndarray) -> np.ndarray:
    """Four bits of every component, sixteen components a word."""
    nibble = (bits >> np.uint64(60)).reshape(len(bits), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(nibble, axis=2)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many components of two lists of sketches differ."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & NIBBLES).sum(axis=1, dtype=np.int64)


def signature_table(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document: class, total weight, sketch, band keys."""
    src = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    schema = T.StructType(
        [
            T.StructField("d", src.schema["d"].dataType),
            T.StructField("h", T.LongType()),
            T.StructField("c", T.BinaryType()),
            T.StructField("weight", T.LongType()),
            T.StructField("sketch", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, j in pieces_of(batch, 2, BLOCK_BYTES):
                texts = [(t or "").encode("utf-8", "surrogatepass").translate(WORDS) for t in batch.column(2).slice(i, j - i).to_pylist()]
                flat, starts = hash_words(b" ".join(texts))
                places = np.cumsum([0, *(len(t) + 1 for t in texts)])
                cuts = np.searchsorted(starts, places)
                n_words, n_docs = np.diff(cuts), len(texts)
                doc, element, weight = bags(flat, n_words)
                sig = bag_min_hash(doc, element, weight, n_docs)
                bits = mixed(sig.view(np.uint64).copy())
                sketch = sketches(bits)
                band = np.zeros((n_docs, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    band = mixed(band * C + bits[:, r : BANDS * ROWS : ROWS] + np.uint64(r))
                band = mixed(band + np.arange(BANDS, dtype=np.uint64) * C).astype(np.int64)
                raw = memoryview(flat.tobytes())
                classes = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(cuts, cuts[1:])]
                total = np.bincount(doc, weights=weight, minlength=n_docs).astype(np.int64)
                ends = np.arange(0, BANDS * n_docs + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(classes, pa.binary()),
                        pa.array(total),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(band.reshape(-1))),
                    ],
                    [x.name for x in schema],
                )

    return src.mapInArrow(tidied(run), schema)


def pairs_in(key, weight, sketch, rank, part, band, bands, limit: int) -> tuple[np.ndarray, ...]:
    """Candidate pairs (i, j) among rows sorted by (key, weight), the distance of
    their sketches, and whether the row i has more candidates than were returned.

    Rows of one part (component) are never paired.  With limit 0 a row is held
    against the first LEADERS rows of its key by rank and against its neighbours
    by weight, and the likeliest one stays: linear.  Otherwise every row whose
    part is not the commonest of its key is held against all rows within the
    weight range, which covers all pairs of parts, and its limit nearest stay; a
    pair counts only in the first band that both rows share.
    """
    n = len(key)
    at = np.arange(n)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(begin, n))
    no = np.repeat(np.arange(len(begin)), length)
    span = int(weight.max()) + 1
    flat = no * span + weight
    hi = np.searchsorted(flat, no * span + np.minimum(DEN * weight // NUM, span - 1), side="right")
    lo = np.searchsorted(flat, no * span + -(-NUM * weight // DEN))

    def test(i, j):
        """The likely ones, with the distance of their sketches."""
        ok = (part[i] != part[j]) & (j >= lo[i]) & (j < hi[i])
        i, j = i[ok], j[ok]
        far = differing(sketch[i], sketch[j])
        ok = far <= MAX_FAR
        i, j, far = i[ok], j[ok], far[ok]
        if limit:
            ok = (bands[i] == bands[j]).argmax(axis=1) == band[i]
            i, j, far = i[ok], j[ok], far[ok]
        return i, j, far

    def nearest(i, j, cost, most):
        o = np.lexsort((rank[j], cost, i))
        i, j, cost = i[o], j[o], cost[o]
        head = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else at[:0]
        count = np.diff(np.append(head, len(i)))
        number = np.arange(len(i)) - np.repeat(head, count)
        keep = number < most
        return i[keep], j[keep], cost[keep], np.repeat(count > most, count)[keep]

    def sweep(rows, start, end):
        """Whole rows at a time, so that the nearest of a row are chosen from all."""
        total = np.cumsum(np.maximum(end - start, 0))
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
            i, j = ranges(start[a:b], end[a:b])
            yield test(rows[a:b][i], j)
            a = b

    joined = lambda parts, k: np.concatenate([at[:0], *(x[k] for x in parts)])
    if limit:
        o = np.lexsort((part, no))
        run = np.flatnonzero(np.concatenate([[True], (no[o][1:] != no[o][:-1]) | (part[o][1:] != part[o][:-1])]))
        size = np.diff(np.append(run, n))
        common = np.zeros(len(begin), dtype=np.int64)
        by_size = np.argsort(size, kind="stable")
        common[no[o][run[by_size]]] = part[o][run[by_size]]
        minor = at[(part != common[no]) & (hi - lo > 1)]
        found = [nearest(*x, limit) for x in sweep(minor, lo[minor], hi[minor])]
        return joined(found, 0), joined(found, 1), joined(found, 2), joined(found, 3).astype(bool)
    by_rank = np.lexsort((rank, no))
    found = []
    for a in range(0, n, PAIRS_AT_ONCE):
        rows = at[a : a + PAIRS_AT_ONCE]
        for k in range(LEADERS):
            found.append(test(rows, by_rank[begin[no[rows]] + np.minimum(k, length[no[rows]] - 1)]))
    found += sweep(at, np.maximum(lo, at - NEAR), np.minimum(hi, at + NEAR + 1))
    i, j, far = (joined(found, k) for k in range(3))
    return nearest(i, j, np.where(far <= SURE_FAR, 0, far), 1)


def likely_pairs(postings: DataFrame, limit: int) -> DataFrame:
    """(c, e, far, more): candidate pairs of classes, c the one that seeks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, 100_000

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda c: t.column(c).to_numpy()
            t = t.take(pa.array(np.lexsort((col("weight"), col("key")))))
            rank = col("rank")
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(rank), -1)
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rank), -1)
            i, j, far, more = pairs_in(col("key"), col("weight"), sketch, rank, col("part"), col("band"), bands, limit)
            if len(i):
                c = t.column("c").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(i)), c.take(pa.array(j)), pa.array(far), pa.array(more)], ["c", "e", "far", "more"]
                )

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
            enough = max(100_000, 2 * rows)
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt = postings.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(tidied(run), "c binary, e binary, far long, more boolean")


def dealt(rows: DataFrame, large: DataFrame | None, everywhere: Column) -> DataFrame:
    """The rows with the keys of large groups salted: a row goes to one part, or to
    all of them where everywhere is true."""
    if large is None:
        return rows
    own = F.array(F.pmod(F.xxhash64("c"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    salts = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).when(everywhere, every).otherwise(own)
    salted = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", "salt"))
    columns = [x for x in rows.columns if x != "key"]
    return rows.join(large, "key", "left").withColumn("salt", F.explode(salts)).select(*columns, salted.alias("key"))


def with_leaders(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """Adds lead: whether a row of a large group is one of its LEADERS, which then
    have the lowest ranks."""
    if large is None:
        return rows.withColumn("lead", F.lit(False))
    least = F.array(*[F.min(F.struct(F.xxhash64("rank", F.lit(k)).alias("h"), F.col("c"))) for k in range(LEADERS)])
    chosen = rows.join(large, "key").groupBy("key").agg(least.alias("x")).select("key", F.explode("x.c").alias("c")).distinct()
    chosen = materialize(chosen.withColumn("lead", F.lit(True)), "near-leaders")
    marked = rows.join(broadcast_if_small(chosen, 96 * chosen.count()), ["key", "c"], "left")
    lead = F.coalesce("lead", F.lit(False))
    low = F.lit(-(1 << 63)) + F.pmod("rank", F.lit(1 << 20))
    return marked.select(*[(F.when(lead, low).otherwise(F.col(x)) if x == "rank" else F.col(x)).alias(x) for x in rows.columns], lead.alias("lead"))


def minor_rows(parts: DataFrame, large: DataFrame | None) -> DataFrame:
    """Adds minor: whether a row of a large group is outside its commonest component."""
    if large is None:
        return parts.withColumn("minor", F.lit(False))
    sizes = parts.join(large, "key").groupBy("key", "part").count()
    common = materialize(sizes.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("common")), "near-common")
    marked = parts.join(broadcast_if_small(common, 48 * common.count()), "key", "left")
    return marked.withColumn("minor", F.coalesce(F.col("part") != F.col("common"), F.lit(False))).drop("common")


def bag_similar(a: Counter, b: Counter) -> bool:
    """Weighted Jaccard of two bags is at least the threshold, in whole numbers."""
    if len(b) < len(a):
        a, b = b, a
    least = sum(min(n, b[x]) for x, n in a.items() if x in b)
    most = sum(a.values()) + sum(b.values()) - least
    return DEN * least >= NUM * most


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The pairs whose bags of shingles have the similarity."""
    ids = pairs.select("c").union(pairs.select("e")).distinct()
    places = materialize(classes.select("c", "d", "h").join(ids, "c", "left_semi"), "near-sought")
    places = broadcast_if_small(places, 96 * places.count())
    src = docs.select(F.col(id_col).alias("sd"), F.xxhash64(text).alias("sh"), F.col(text).alias("t"))
    on = src["sd"].eqNullSafe(places["d"]) & (src["sh"] == places["h"])
    texts = materialize(src.join(places, on).groupBy("c").agg(F.first("t").alias("t")), "near-texts")
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    texts = broadcast_if_small(texts, n_bytes)
    both = pairs.select("c", "e").join(texts, "c").join(texts.select(F.col("c").alias("e"), F.col("t").alias("u")), "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Counter] = {}
        held = 0

        def bag(c: pa.Scalar, text: pa.Scalar) -> Counter:
            nonlocal held
            key = c.as_py()
            if key not in known:
                made = shingles_of(words_of(text.as_py()))
                if held + len(made) > KNOWN_SHINGLES:
                    known.clear()
                    held = 0
                known[key], held = made, held + len(made)
            return known[key]

        for batch in batches:
            keep = [bag_similar(bag(c, t), bag(e, u)) for e, c, t, u in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], ["c", "e"]).filter(pa.array(keep, pa.bool_()))

    return both.select("e", "c", "t", "u").mapInArrow(tidied(run), "c binary, e binary")


def components(edges: DataFrame, name: str = "near") -> DataFrame:
    """(c, label): every node of the edges (c, e) with the smallest node of its
    component, by alternating large-star and small-star steps.  No step gathers
    the neighbours of a node: they go to its smallest neighbour by a join that
    adaptive execution may split."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        n = e.union(e.select(F.col("v"), F.col("u"))) if large else e
        least = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        j = n.join(least, "u")
        if large:
            return j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        moved = j.select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()

    e = edges.select(F.greatest("c", "e").alias("u"), F.least("c", "e").alias("v")).filter("u != v").distinct()
    e = materialize(e, name)
    state = None
    while True:
        e = materialize(star(star(e, True), False), name)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("c"), "label")


def in_order(pairs: DataFrame) -> DataFrame:
    """The pairs with c the greater class, so that each has one form."""
    return pairs.select(F.greatest("c", "e").alias("c"), F.least("c", "e").alias("e"), *[x for x in pairs.columns if x not in ("c", "e")])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, group, keep, n) per row: its group's class, smallest identifier and size."""
    table = materialize(signature_table(docs, id_col, text_col), "near-signatures")
    classes = materialize(
        table.filter("c IS NOT NULL")
        .groupBy("c", "weight", "sketch")
        .agg(F.min(F.struct("d", "h", "bands")).alias("m"))
        .select("c", "weight", "sketch", "m.d", "m.h", "m.bands"),
        "near-classes",
    )
    short = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("bands")
    postings = classes.select("c", "weight", "sketch", F.xxhash64("c").alias("rank"), short, F.posexplode("bands").alias("band", "key"))
    keys = materialize(classes.select(F.explode("bands").alias("key")).groupBy("key").count().filter("count > 1"), "near-keys")
    large = keys.filter(F.col("count") > GROUP).select("key", F.ceil(F.col("count") / GROUP).alias("parts"))
    n_large = large.count()
    large = broadcast_if_small(large, 32 * n_large) if n_large else None
    keys = broadcast_if_small(keys.select("key"), 32 * keys.count())
    shared = materialize(postings.join(keys, "key", "left_semi"), "near-shared")
    led = with_leaders(shared.withColumn("part", F.xxhash64("c")), large)
    first = likely_pairs(dealt(led, large, F.col("lead")).drop("lead"), 0)
    first = first.groupBy("c").agg(F.min(F.struct("far", "e")).alias("m")).select("c", F.col("m.e").alias("e"))
    tried = materialize(in_order(first).distinct(), "near-pairs")
    links = materialize(verified(tried, classes, docs, id_col, text_col), "near-links")
    labels = materialize(components(links), "near-labels")
    limit = 1  # then all
    while True:  # until no row between components has candidates left untried
        parts = shared.join(labels, "c", "left").withColumn("part", F.xxhash64(F.coalesce("label", "c"))).drop("label")
        parts = dealt(minor_rows(parts, large), large, F.col("minor")).drop("minor")
        found = materialize(in_order(likely_pairs(parts, limit)).groupBy("c", "e").agg(F.max("more").alias("more")), "near-pairs")
        fresh = materialize(found.select("c", "e").join(tried, ["c", "e"], "left_anti"), "near-fresh")
        if not fresh.isEmpty():
            more = materialize(verified(fresh, classes, docs, id_col, text_col), "near-links")
            tried = tried.union(fresh)
            if not more.isEmpty():
                links = links.union(more)
                labels = materialize(components(links), "near-labels")
        if found.filter("more").isEmpty():
            break
        limit = 1 << 40
    discard(shared)
    rows = table.select("d", "h", "c").join(labels, "c", "left").select("d", "h", F.coalesce("label", "c").alias("group"))
    groups = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("d").alias("keep"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, "group", "left").select(
        "d",
        "h",
        "group",
        F.when(F.col("group").isNull(), F.col("d")).otherwise(F.col("keep")).alias("keep"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept."""
    return near_groups(docs, id_col, text_col).select(
        F.col("d").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("d").eqNullSafe(F.col("keep")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, of which each group keeps the one
    with the smallest identifier."""
    gone = near_groups(docs, id_col, text_col).filter(~F.col("d").eqNullSafe(F.col("keep")))
    gone = materialize(gone.select(F.col("d").alias("_nd_d"), F.col("h").alias("_nd_h")).distinct(), "near-gone")
    gone = broadcast_if_small(gone, 64 * gone.count())
    on = docs[id_col].eqNullSafe(gone["_nd_d"]) & (F.xxhash64(docs[text_col]) == gone["_nd_h"])
    return docs.join(gone, on, "left_anti").select(*[docs[c] for c in docs.columns])
