"""Merkle manifest of a dataset: a tree per group, a tree over the groups, and
an inclusion proof for every row.

Bottom up: the leaves of a group stand in the order of their identifiers; every
``fan`` neighbours (the last run may be shorter, even one) become the digest of
their digests, written one after the other as lower-case hex.  Each level is a table in
the shared folder; a parent keeps the digests of its children.  The roots of the
groups, in the order of the groups, are the leaves of the tree above.

Top down: from the root, the children of a level join their parents; a child
prepends its siblings (those to its left and those to its right) to the
proof it inherits.  A proof so is an array with one step a level, and folds back to the
root by a higher-order function; no row needs another row for that.

Distribution: texts are read once and leave the scan as digests.  The places of
leaves come from a range sort and one row per partition and group, so a
group of any size spreads over tasks; every later shuffle has at most ``fan`` rows a
key.  The driver gets the height of the trees and the root.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, ``:`` and
its value; a null group is the first one; a null identifier comes before
others; rows of equal identifier stand in the order of their leaf digests; equal rows
have equal digests, so each has a valid proof; a lone leaf is its group's
root, a lone group's root is the root; an empty table gives an empty result.
Only the named fields are read, so other columns may be called anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, materialize, placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:binary,right:binary>>"


def stated(value: Column) -> Column:
    """A field as it goes into a leaf: null and any value stay distinct."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of a row, as hex."""
    return F.sha2(F.concat(*[stated(v) for v in values]), 256)


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """Digests one after the other, as they are."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def grown(leaves: DataFrame, fan: int, name: str) -> list[DataFrame]:
    """The levels (g, i, n, digest, kids) over leaves (g, i, n, digest): n is the
    number of nodes that the tree g has on the level.  The last level of a
    tree is the one where n is 1."""
    level = leaves.withColumn("kids", F.lit(None).cast("array<binary>"))
    levels, most = [level], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // fan)
        up = levels[-1].filter("n > 1").groupBy("g", F.floor(F.col("i") / fan).alias("i"), F.ceil(F.col("n") / fan).alias("n"))
        kids = F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda k: k["digest"])
        up = up.agg(kids.alias("kids"))
        digest = F.unhex(F.sha2(F.array_join(F.transform("kids", as_hex), ""), 256))
        levels.append(materialize(up.select("g", "i", "n", digest.alias("digest"), "kids"), f"{name}-level", release=False))
    return levels


def pushed(levels: list[DataFrame], tops: DataFrame, fan: int, name: str) -> DataFrame:
    """(g, i, proof, top) of the leaves: tops has the proof (g, above) of each
    tree's own root; a level is written before the next one below joins it."""
    down = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        here = level.filter("n = 1").join(tops, "g")
        here = here.select("g", "i", "kids", F.col("above").alias("proof"), F.col("digest").alias("top"))
        if down is not None:
            parents = down.select(
                "g", F.col("i").alias("up"), F.col("kids").alias("run"), F.col("proof").alias("rest"), F.col("top").alias("top")
            )
            kids = level.filter("n > 1").withColumn("up", F.floor(F.col("i") / fan)).join(parents, ["g", "up"])
            place = (F.col("i") % fan).cast("int")
            step = F.struct(
                joined(F.slice("run", F.lit(1), place)).alias("left"), joined(F.slice("run", place + 2, F.lit(fan))).alias("right")
            )
            here = here.unionByName(kids.select("g", "i", "kids", F.concat(F.array(step), F.col("rest")).alias("proof"), "top"))
        above = down
        down = materialize(here, f"{name}-proofs", release=False)
        if above is not None:
            discard(above, levels[k + 1])
    return down.select("g", "i", "proof", "top")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof lead to, as hex."""
    up = lambda a, s: F.sha2(F.concat(as_hex(s["left"]), a, as_hex(s["right"])), 256)
    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(as_hex(s["left"]), as_hex(s["right"]))), ""), 256)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    claim: Column | None = None,
    fan: int = 3,
) -> DataFrame:
    """One row per document: id, leaf, subroot, root (hex), proof, and the root
    (``folded_root``) to which the claimed leaf and the proof lead, with whether
    it is the true one (``verified``).

    claim is the leaf (hex, a column over docs) that someone asserts for the row, the
    row's own leaf if none is given; a changed row so fails against its proof.
    """
    own = leaf_of([F.col(c) for c in fields])
    leaves = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(group_col).cast("string").alias("_group"),
            F.unhex(own).alias("_leaf"),
            F.unhex(own if claim is None else claim).alias("_claim"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "merkle-leaves",
    )
    spread = placed(leaves, "_group", ["_id", "_leaf", "_row"], "merkle-order")
    groups = leaves.select("_group").distinct().withColumn("_all", F.lit(0))
    groups = placed(groups, "_all", ["_group"], "merkle-groups").select("_group", F.col("_i").alias("g"), F.col("_n").alias("_groups"))
    groups = materialize(groups, "merkle-group-order", release=False)
    named = broadcast_if_small(groups.withColumnRenamed("_group", "_of"), 200 * groups.count())
    base = materialize(
        spread.join(named, F.col("_group").eqNullSafe(F.col("_of"))).select(
            "g", F.col("_i").alias("i"), F.col("_n").alias("n"), F.col("_leaf").alias("digest"), "_id", "_claim", "_groups"
        ),
        "merkle-base",
    )
    levels = grown(base.select("g", "i", "n", "digest"), fan, "merkle")
    n_groups = groups.count()
    one = (F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(n_groups).cast("long").alias("n"), "digest")
    roots = levels[0].filter("n = 1").select(*one)
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("n = 1").select(*one))
    top = grown(materialize(roots, "merkle-roots", release=False), fan, "merkle-top")
    start = docs.sparkSession.range(1).select(F.col("id").alias("g"), F.array().cast(STEPS).alias("above"))
    above = pushed(top, start, fan, "merkle-top").select(F.col("i").alias("g"), F.col("proof").alias("above"), F.col("top").alias("root"))
    above = materialize(above, "merkle-above", release=False)
    tops = broadcast_if_small(above.select("g", "above"), 2000 * n_groups)
    found = above.select("root").first()
    proofs = pushed(levels, tops, fan, "merkle")
    root = as_hex(F.lit(bytes(found["root"]) if found else b""))
    rows = base.select("g", "i", "_id", F.col("digest").alias("_leaf"), "_claim").join(proofs, ["g", "i"])
    out = rows.select(
        F.col("_id").alias(id_col),
        as_hex(F.col("_leaf")).alias("leaf"),
        as_hex(F.col("top")).alias("subroot"),
        root.alias("root"),
        "proof",
        folded(as_hex(F.col("_claim")), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
