"""Removal of passages that an earlier document has, by automata over recurring
phrases.

A window is WINDOW neighbouring words.  A word goes if a window over it also stands
in a document with a smaller identifier.  The steps:

1. Every window names its least PHRASE-word phrase (by a hash).  Equal windows name equal
   phrases, and neighbouring windows mostly share theirs, so a document gives about one
   phrase per 18 words.  A phrase of a single document cannot be part of a recurring
   window; all other phrases recur.  Documents with equal words are one class; only
   its smallest identifier looks further, the others lose all windows at once.
2. Documents with recurring phrases give up the pieces whose windows name them,
   dealt out to shards by phrase.  All windows of a phrase are in one shard.
3. Recurring passages are confirmed: the windows of the pieces meet by a 128-bit BLAKE2
   digest of their text; those in two documents or more stay, with the
   smallest identifier that has them, and so do their phrases.
4. Each shard compiles an Aho-Corasick automaton (pyahocorasick, over words as
   numbers) from its confirmed phrases and streams its pieces: an occurrence
   of a phrase tells where windows may recur, and their digests, looked up among the shard's
   confirmed ones, tell which do, and since which document.
5. Intervals come together per document and its words are cut out.

A text that names no recurring phrase cannot hold a recurring window, so it is
streamed through no automaton, and a document meets only the shards of its own phrases:
the work grows with the recurring text, not with documents times shards.  A
shard has SHARD_PHRASES phrases or about as many; its pieces are salted into
parts of PART_BYTES, each with the shard's automaton, so a passage of a third of all
documents spreads over tasks.  Worker memory holds one automaton and one batch.

Defined cases: null text has no words; fewer words than a window lose nothing; rows of equal
identifier do not remove each other's words; a null identifier neither removes
nor loses words; an empty table gives an empty result.  Windows are judged on the
input.  Only the identifier and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, discard, materialize, pieces_of, placed, text_or_empty, tidied
from .wordhash import hash_segments, mixed

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 50
PHRASE = 16
SPAN = WINDOW - PHRASE + 1  # phrases in a window
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 2 << 20
SHARD_PHRASES = 4096
PART_BYTES = 8 << 20
PATTERN, KNOWN, PIECE = 0, 1, 2


def words_of(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


class Block:
    """Texts (words with single spaces, none empty) cut into words together."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts) + b" "
        b = np.frombuffer(self.data, dtype=np.uint8)
        self.ends = np.flatnonzero(b == 32)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.words = hash_segments(b, self.starts)
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))  # first word of each text

    def phrases(self) -> np.ndarray:
        """The hash of the phrase that starts at each word; the last words, where no phrase
        fits, have none.  Phrases that run into the next text are there too."""
        n = len(self.words) - PHRASE + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = self.words[:n].copy()
        for k in range(1, PHRASE):
            h *= BASE
            h += self.words[k : k + n]
        return mixed(h)

    def named(self, phrases: np.ndarray) -> np.ndarray:
        """The least phrase of each window, as a signed number."""
        low, wide = phrases, 1
        while 2 * wide <= SPAN:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        rest = SPAN - wide
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        return low.view(np.int64)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (exclusive) as text."""
        return self.data[self.starts[a] : self.ends[b - 1]]

    def digests(self, a: int, b: int) -> list[bytes]:
        """The digests of the windows that start at words a to b (exclusive)."""
        data, starts, ends = self.data, self.starts[a:b].tolist(), self.ends[a + WINDOW - 1 : b + WINDOW - 1].tolist()
        return [hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(starts, ends)]


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], Block | None]]:
    """(rows, block) of a batch; rows with an empty text are in no block."""
    for i, j in pieces_of(batch, column, BLOCK_BYTES):
        texts = batch.column(column).slice(i, j - i).cast(pa.binary()).to_pylist()
        rows = [k for k, t in enumerate(texts) if t]
        yield [i + k for k in rows], Block([texts[k] for k in rows]) if rows else None


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row..., words): number of words and the distinct phrases that the windows name."""
    for batch in batches:
        counts = np.zeros(batch.num_rows, dtype=np.int64)
        lists: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * batch.num_rows
        for rows, block in blocks(batch, 2):
            if block is None:
                continue
            size = np.diff(block.first)
            counts[rows] = size
            if size.max() < WINDOW:
                continue
            named = block.named(block.phrases())
            for row, a, n in zip(rows, block.first, size):
                if n >= WINDOW:
                    lists[row] = np.unique(named[a : a + n - WINDOW + 1])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["_id", "_sha", "_n", "_phrases"],
        )


PIECES = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("phrase", T.LongType()),
        T.StructField("rank", T.LongType()),
        T.StructField("no", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
NAMES = [f.name for f in PIECES]
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def cut_pieces(shards: int):
    """Over (no, rank, text, phrases): the stretches of windows of a text whose recurring
    phrases lie in one shard, and the recurring phrases with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rows, block in blocks(batch, 2):
                if block is None:
                    continue
                phrases = block.phrases()
                named, signed = block.named(phrases), phrases.view(np.int64)
                for row, a, n in zip(rows, block.first.tolist(), np.diff(block.first).tolist()):
                    if n < WINDOW:
                        continue
                    no, rank, known = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), np.array(batch.column(3)[row].as_py())
                    here = named[a : a + n - WINDOW + 1]
                    shard = np.where(np.isin(here, known), np.mod(here, shards), -1)
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
                    for i, j in zip(edges, edges[1:]):
                        if shard[i] >= 0:
                            out.append((PIECE, int(here[i]), rank, no, i, block.text(a + i, a + j - 1 + WINDOW).decode()))
                    found, at = np.unique(signed[a : a + n - PHRASE + 1], return_index=True)
                    wanted = np.isin(found, known)
                    for phrase, k in zip(found[wanted].tolist(), at[wanted].tolist()):
                        out.append((PATTERN, phrase, None, None, None, block.text(a + k, a + k + PHRASE).decode()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], NAMES)
                    out = []

    return run


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces (rank, text): every window's digest, phrase and document."""
    for batch in batches:
        ranks = batch.column(0).to_pylist()
        for rows, block in blocks(batch, 1):
            if block is None:
                continue
            named = block.named(block.phrases())
            found: list[bytes] = []
            phrase, rank = [], []
            for row, a, n in zip(rows, block.first.tolist(), np.diff(block.first).tolist()):
                m = n - WINDOW + 1
                found += block.digests(a, a + m)
                phrase.append(named[a : a + m])
                rank.append(np.full(m, ranks[row], dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(np.concatenate(phrase)), pa.array(np.concatenate(rank))], ["window", "phrase", "rank"]
            )


STREAM = "shard int, salt int, kind int, rank long, no long, start long, text string, window binary"


class Shard:
    """The automaton over a shard's phrases and its confirmed windows."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        self.since: dict[bytes, int] = {}
        self.ready = False

    def learn(self, phrases: list[bytes]) -> None:
        block = Block(phrases)
        ids = numbers(block).tolist()
        for a in block.first[:-1].tolist():
            self.automaton.add_word(tuple(ids[a : a + PHRASE]))

    def removed(self, block: Block, a: int, n: int, rank: int, ids: list[int]) -> list[tuple[int, int]]:
        """The intervals of words, from the piece's first, that an earlier document has."""
        if not len(self.automaton):  # none of the shard's phrases is confirmed
            return []
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        m = n - WINDOW + 1
        near = np.zeros(m + 1, dtype=np.int32)
        for end, _ in self.automaton.iter(tuple(ids[a : a + n])):
            p = end - PHRASE + 1
            near[max(0, p - SPAN + 1)] += 1
            near[min(m, p + 1)] -= 1
        asked = np.cumsum(near[:m]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], asked.view(np.int8), [0]]))).tolist()
        out: list[tuple[int, int]] = []
        for i, j in zip(edges[::2], edges[1::2]):
            for k, digest in enumerate(block.digests(a + i, a + j), i):
                if self.since.get(digest, rank) < rank:
                    if out and out[-1][1] >= k:
                        out[-1] = (out[-1][0], k + WINDOW)
                    else:
                        out.append((k, k + WINDOW))
        return out


def numbers(block: Block) -> np.ndarray:
    """Words as the automaton knows them."""
    return (block.words >> np.uint64(33)).astype(np.int64)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shard, salt and kind: first what the shard knows, then
    the pieces that stream through its automaton; (no, from, to) of removed words."""
    now, shard = None, Shard()
    for batch in batches:
        key = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))
        kind = np.asarray(batch.column(2))
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1, [len(key)]]).tolist()
        out: list[tuple[int, int, int]] = []
        for i, j in zip(cuts, cuts[1:]):
            if key[i] != now:
                now, shard = key[i], Shard()
            part = batch.slice(i, j - i)
            if kind[i] == PATTERN:
                shard.learn([t.encode() for t in part.column(6).to_pylist()])
            elif kind[i] == KNOWN:
                shard.since.update(zip(part.column(7).to_pylist(), part.column(3).to_pylist()))
            else:
                ranks, nos, starts = (part.column(c).to_pylist() for c in (3, 4, 5))
                for rows, block in blocks(part, 6):
                    ids = numbers(block).tolist()
                    for row, a, n in zip(rows, block.first.tolist(), np.diff(block.first).tolist()):
                        out += [(nos[row], starts[row] + p, starts[row] + q) for p, q in shard.removed(block, a, n, ranks[row], ids)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["no", "first", "last"])


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (id, sha, text, intervals): number of removed words, the text without them."""
    for batch in batches:
        n_removed, kept = [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = text.split(" ")
            gone = np.zeros(len(words) + 1, dtype=np.int32)
            for s in spans:
                gone[s["first"]] += 1
                gone[s["last"]] -= 1
            stay = (np.cumsum(gone[:-1]) == 0).tolist()
            left = [w for w, k in zip(words, stay) if k]
            n_removed.append(len(words) - len(left))
            kept.append(" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["_id", "_sha", "_removed", "_kept"]
        )


def ranked(docs: DataFrame) -> DataFrame:
    """Adds ``rank``: whole numbers in the order of the identifiers."""
    if isinstance(docs.schema["_id"].dataType, T.IntegralType):
        return docs.withColumn("rank", F.col("_id").cast("long"))
    ids = placed(docs.select("_id").distinct().withColumn("_all", F.lit(0)), "_all", ["_id"], "repeat-ids")
    return docs.join(ids.select("_id", F.col("_i").alias("rank")), "_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text, kept_sha256.  kept_text
    is null where nothing goes (the text stays as it is); the digest is that of the kept words
    with one space between them, of the document's own words where nothing goes."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), words_of(text_or_empty(text_col)).alias("_text"))
    source = source.select("_id", F.sha2("_text", 256).alias("_sha"), "_text")
    base = materialize(source.mapInArrow(tidied(described), f"_id {kind}, _sha string, _n long, _phrases array<long>"), "repeat-base")
    classes = base.groupBy("_sha").agg(F.min("_id").alias("_keep"))
    marked = base.join(classes, "_sha")
    named = materialize(marked.filter("_id = _keep").select("_id", "_sha", F.explode("_phrases").alias("phrase")), "repeat-phrases")
    seen = named.groupBy("phrase").agg(F.min("_id").alias("a"), F.max("_id").alias("b"))
    recurring = materialize(seen.filter("a < b").select("phrase"), "repeat-recurring")
    n_recurring = recurring.count()
    shards = max(1, -(-n_recurring // SHARD_PHRASES))
    wanted = named.join(broadcast_if_small(recurring, 40 * n_recurring), "phrase").groupBy("_id", "_sha").agg(F.collect_set("phrase").alias("_phrases"))
    wanted = materialize(wanted, "repeat-wanted")
    held = wanted.agg(F.coalesce(F.sum(F.size("_phrases") * 8 + 150), F.lit(0))).first()[0]
    found = ranked(source.join(broadcast_if_small(wanted, held), ["_id", "_sha"]))
    found = materialize(found.select(F.monotonically_increasing_id().alias("no"), "rank", "_text", "_phrases", "_id", "_sha"), "repeat-texts")
    discard(named)

    cut = found.select("no", "rank", "_text", "_phrases").mapInArrow(tidied(cut_pieces(shards)), PIECES)
    cut = materialize(cut, "repeat-pieces")
    pieces = cut.filter(F.col("kind") == PIECE)
    all_windows = pieces.select("rank", "text").mapInArrow(tidied(windows), "window binary, phrase long, rank long")
    met = all_windows.groupBy("window").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"), F.min("phrase").alias("phrase"))
    known = materialize(met.filter("rank < last").select("window", "phrase", "rank"), "repeat-windows")
    patterns = cut.filter(F.col("kind") == PATTERN).select("phrase", "text").distinct().join(known.select("phrase").distinct(), "phrase", "left_semi")

    shard = F.pmod("phrase", F.lit(shards)).cast("int").alias("shard")
    pieces = pieces.select(shard, "rank", "no", "start", "text")
    parts = pieces.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("text")) / PART_BYTES).cast("int").alias("parts"))
    parts = F.broadcast(materialize(parts, "repeat-parts", release=False)) if shards <= 100_000 else parts
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    none = lambda t: F.lit(None).cast(t)
    rows = patterns.select(shard, "text").join(parts, "shard").select(
        "shard", each, F.lit(PATTERN).alias("kind"), none("long").alias("rank"), none("long").alias("no"), none("long").alias("start"), "text", none("binary").alias("window")
    )
    rows = rows.unionByName(
        known.select(shard, "rank", "window").join(parts, "shard").select(
            "shard", each, F.lit(KNOWN).alias("kind"), "rank", none("long").alias("no"), none("long").alias("start"), none("string").alias("text"), "window"
        )
    )
    salt = F.pmod(F.hash("no", "start"), F.col("parts")).alias("salt")
    rows = rows.unionByName(
        pieces.join(parts, "shard").select("shard", salt, F.lit(PIECE).alias("kind"), "rank", "no", "start", "text", none("binary").alias("window"))
    )
    rows = rows.select("shard", "salt", "kind", "rank", "no", "start", "text", "window")
    rows = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = materialize(rows.mapInArrow(tidied(streamed), "no long, first long, last long"), "repeat-spans")
    spans = spans.groupBy("no").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    lost = found.join(spans, "no").select("_id", "_sha", "_text", "spans")
    lost = lost.mapInArrow(tidied(cut_words), f"_id {kind}, _sha string, _removed long, _kept string")
    lost = lost.withColumn("_kept_sha", F.sha2("_kept", 256)).dropDuplicates(["_id", "_sha"])

    rest = marked.select("_id", "_sha", "_n", F.coalesce((F.col("_id") > F.col("_keep")) & (F.col("_n") >= WINDOW), F.lit(False)).alias("_copy"))
    out = rest.join(lost, ["_id", "_sha"], "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_words"),
        F.when(F.col("_copy"), F.col("_n")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), F.lit("")).otherwise(F.col("_kept")).alias("kept_text"),
        F.when(F.col("_copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept_sha", "_sha")).alias("kept_sha256"),
    )
