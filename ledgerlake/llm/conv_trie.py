"""Prefix trie of conversations: which conversations begin alike, and what
keeping their common beginnings once would save.

1. Every turn becomes 24 bytes: half a SHA-256 of role and text, and the size of
   the text.  A conversation is the array of its turns.
2. The arrays are sorted by range over the whole corpus.  Any order of the turns
   does, as long as arrays with a common beginning are neighbours; rows with equal
   arrays are cut apart by identifier, so a first turn or a whole conversation
   that a third of the corpus shares spreads over tasks.
3. Each partition is swept once with a stack: the longest common prefix (LCP) with the row
   before tells which nodes end (their LCP interval is whole) and which begin.
   Counts, smallest member, leaves and savings go from a node to its parent as it ends.
4. Nodes on the path of a partition's first or last row may go on in its
   neighbours.  They leave the sweep as open parts, one row each, and one task goes through
   the partitions in order, keeps one stack, and joins the parts of a node.
   That task reads two paths per partition, however many conversations there are.
5. A node names its parent by number; one join gives the parent's smallest member.

Defined cases: a null role or text is empty; turns stand in ascending order, null
first, and turns of equal number in the order of their digests; a null conversation
identifier is no conversation; a conversation without turns is a member
of the root only; repeated turns stay; an empty table has no nodes.  A
conversation is one row of 24 bytes a turn, so its length is bounded by a row's size
(tens of millions of turns).  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidied

WIDTH = 24
SIZE_AT = 16
ROWS_OUT = 20_000
CLOSED, REF = 0, 4
SHARED, FIRST, LAST = 1, 2, 3  # open parts: on both paths, on the first row's, on the last row's

SWEPT = pa.schema(
    [
        ("kind", pa.int32()),
        ("part", pa.int64()),
        ("no", pa.int64()),
        ("parent", pa.int64()),
        ("depth", pa.int64()),
        ("n", pa.int64()),
        ("low", pa.int64()),
        ("children", pa.int64()),
        ("leaves", pa.int64()),
        ("saved", pa.int64()),
        ("turn", pa.binary()),
        ("ends", pa.string()),
    ]
)
SWEPT_DDL = "kind int, part long, no long, parent long, depth long, n long, low long, children long, leaves long, saved long, turn binary, ends string"


def turn_key(role: Column, text: Column) -> Column:
    """24 bytes that stand for a turn: equal only for equal role and text."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (WIDTH - SIZE_AT), "0")
    return F.unhex(F.concat(F.substring(said, 1, 2 * SIZE_AT), size))


def turn_arrays(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): the ordered turns of each conversation as keys."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("at"), turn_key(F.col(role_col), F.col(text_col)).alias("key")).alias("said"))
    grouped = rows.filter("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("all"))
    return grouped.select("conv", F.transform("all", lambda t: t["key"]).alias("turns"))


class Node:
    __slots__ = ("no", "turn", "n", "low", "children", "leaves", "saved", "ends", "open", "refs")

    def __init__(self, no: int, turn: bytes, opened: bool = False):
        self.no, self.turn, self.open = no, turn, opened
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends: list[str] = []
        self.refs: list[tuple[int, int]] = []

    def whole(self) -> tuple[int, int]:
        """(leaves, saved) of the subtree once all of it is known."""
        return self.leaves if self.children else 1, self.saved + (self.n - 1) * int.from_bytes(self.turn[SIZE_AT:], "big")

    def take(self, child: Node) -> None:
        leaves, saved = child.whole()
        self.add(child.n, child.low, 1, leaves, saved)

    def add(self, n: int, low: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if low is not None and (self.low is None or low < self.low):
            self.low = low


def common_turns(a: bytes, b: bytes) -> int:
    """Number of whole turns with which both arrays begin."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    least = 0
    while most - least > 1:
        mid = (least + most) // 2
        if a[: mid * WIDTH] == b[: mid * WIDTH]:
            least = mid
        else:
            most = mid
    return least


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    lists = batch.column(1)
    ends, flat = lists.offsets.to_pylist(), lists.values
    for conv, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:]):
        yield conv, b"".join(flat.slice(a, b - a).to_pylist())


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SWEPT)], schema=SWEPT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SWEPT)], schema=SWEPT)


def sweep(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    """The nodes of one sorted partition: whole ones as rows of kind CLOSED, what
    lies on the first or the last row's path as open parts."""
    stack: list[Node] = []
    before, made = b"", 0
    first: list[tuple] = []

    def opened(kind: int, node: Node, depth: int) -> tuple:
        up = None if depth == 0 else 0
        return (kind, part, node.no, up, depth, node.n, node.low, node.children, node.leaves, node.saved, node.turn, ",".join(node.ends))

    for conv, key in rows:
        start = not stack
        if start:
            stack.append(Node(0, b"", True))
            made, keep = 1, 0
        else:
            keep = common_turns(before, key)
        while len(stack) - 1 > keep:
            node, depth = stack.pop(), len(stack)
            if node.open:
                first.append(opened(FIRST, node, depth))
                continue
            leaves, saved = node.whole()
            ends = hashlib.sha256(",".join(node.ends).encode()).hexdigest()
            yield (CLOSED, part, node.no, stack[-1].no, depth, node.n, node.low, node.children, leaves, saved, None, ends)
            stack[-1].take(node)
        for k in range(keep, len(key) // WIDTH):
            stack.append(Node(made, key[k * WIDTH : (k + 1) * WIDTH], start))
            made += 1
        stack[-1].add(1, conv, 0, 0, 0)
        stack[-1].ends.append(str(conv))
        before = key
    yield from first
    for depth, node in enumerate(stack):
        yield opened(SHARED if node.open else LAST, node, depth)


def stitch(rows: Iterator[dict]) -> Iterator[tuple]:
    """Open parts in the order of partition, path and depth: the whole nodes that they
    make up (part -1), and for each part the node it belongs to (kind REF)."""
    stack: list[Node] = []
    made = 0

    def closed() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        leaves, saved = node.whole()
        yield (CLOSED, -1, node.no, stack[-1].no if stack else None, depth, node.n, node.low, node.children, leaves, saved, None, node.ends.hexdigest())
        for part, no in node.refs:
            yield (REF, part, no, None, None, None, node.low, None, None, None, None, None)
        if stack:
            stack[-1].take(node)

    def joined(path: list[dict]) -> Iterator[tuple]:
        nonlocal made
        for r in path:
            d = r["depth"]
            if len(stack) > d and stack[d].turn != r["turn"]:
                while len(stack) > d:
                    yield from closed()
            if len(stack) == d:
                node = Node(made, r["turn"])
                node.ends = hashlib.sha256()
                node.open = False  # whether an end has been written
                stack.append(node)
                made += 1
            node = stack[d]
            node.add(r["n"], r["low"], r["children"], r["leaves"], r["saved"])
            node.refs.append((r["part"], r["no"]))
            if r["ends"]:
                node.ends.update((("," if node.open else "") + r["ends"]).encode())
                node.open = True
        while path and len(stack) > path[-1]["depth"] + 1:
            yield from closed()

    def partition(parts: list[dict]) -> Iterator[tuple]:
        paths = {k: [r for r in parts if r["kind"] == k] for k in (SHARED, FIRST, LAST)}
        yield from joined(paths[SHARED] + paths[FIRST])
        if paths[FIRST]:  # the first row's own path ends inside the partition
            while len(stack) > len(paths[SHARED]):
                yield from closed()
        yield from joined(paths[LAST])

    held: list[dict] = []
    for r in rows:
        if held and held[0]["part"] != r["part"]:
            yield from partition(held)
            held = []
        held.append(r)
    if held:
        yield from partition(held)
    while stack:
        yield from closed()


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv, turns), see turn_arrays: conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        yield from batches_of(sweep(part, (row for batch in batches for row in rows_of(batch))))

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(stitch(r for batch in batches for r in batch.to_pylist()))

    kept = materialize(arrays.select("conv", "turns"), "trie-arrays")
    order = kept.repartitionByRange("turns", "conv").sortWithinPartitions("turns", "conv")
    parts = materialize(order.mapInArrow(tidied(swept), SWEPT_DDL), "trie-nodes", release=False)
    opened = parts.filter(F.col("kind").isin(SHARED, FIRST, LAST)).repartition(1).sortWithinPartitions("part", "kind", "depth")
    joins = materialize(opened.mapInArrow(tidied(stitched), SWEPT_DDL), "trie-stitched", release=False)
    discard(kept)
    known = parts.filter(F.col("kind") == CLOSED).unionByName(joins)
    ids = known.select("part", F.col("no").alias("parent"), F.col("low").alias("parent_conv_id"))
    nodes = known.filter(F.col("kind") == CLOSED).join(ids, ["part", "parent"], "left")
    return nodes.select(
        F.col("low").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
