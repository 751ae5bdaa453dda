"""Exact deduplication by a tree-merge of sorted digest runs (native plan).

Every input partition sorts its digests into one run, each digest with its
smallest identifier and its count.  Runs are cut into slices by the leading bits of
the digest, so that a run of any length spreads over tasks, and meet in binomial
rounds: in each round 2**fan_bits neighbouring runs are exchanged slice by slice,
merged in digest order and reduced by a sort aggregation into one sorted run, which
keeps, per digest, the smallest identifier and the summed count.  A digest
counts as the same only if the SHA-256, a second independent 64-bit hash and
the byte length all agree, so the identifier kept is verified at every level.
Equal digests are reduced before the exchange, so a text with a third of
all copies crosses each exchange as one row per run.

The number of runs and slices follows the number of input partitions: there is a
run for each of them (up to MOST_RUNS, beyond which neighbouring partitions share
one), and about as many slices.

Defined cases: a null text counts as empty; two texts are equal when identical
after each run of ``[\\x20\\x09-\\x0D]`` becomes one space (no trimming); of rows
that share text and identifier all carry the same answer; a null identifier
never beats another one, and a class with null identifiers only keeps null
(``kept`` is then true).  An empty table gives an empty result.  Columns other
than the identifier and the text are not read, so clashing names are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"
KEY = ["_sha", "_h64", "_len"]


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier, digest of the normalised text, run."""
    norm = F.regexp_replace(text_or_empty(text_col), WHITE, " ")
    return docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).select(
        "_id",
        F.sha2("_norm", 256).alias("_sha"),
        F.xxhash64("_norm").alias("_h64"),
        F.octet_length("_norm").cast("long").alias("_len"),
    )


MOST_RUNS = 4096


def merge_runs(digests: DataFrame, runs: int, fan_bits: int = 3) -> DataFrame:
    """Binomial rounds over sorted runs: (digest key, smallest id, count).

    The smallest identifier is kept as a struct, which Spark reduces by sorting,
    not by hashing: in the first round the part before the exchange makes the runs,
    then each task merges one slice of a group of runs in digest order."""
    slices = 1 << max(runs - 1, 0).bit_length()
    lead = F.conv(F.substring("_sha", 1, 4), 16, 10).cast("int")
    level = digests.select(
        (F.spark_partition_id() % F.lit(runs)).alias("_run"),
        (lead % F.lit(slices)).alias("_slice"),
        *KEY,
        F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id")).alias("_first"),
        F.lit(1).cast("long").alias("_n"),
    )
    left, first_round = runs, True
    while first_round or left > 1:
        left = -(-left // (1 << fan_bits))
        level = level.withColumn("_run", F.shiftright("_run", fan_bits))
        if not first_round:
            level = level.repartition("_run", "_slice").sortWithinPartitions("_run", "_slice", *KEY)
        level = level.groupBy("_run", "_slice", *KEY).agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
        first_round = False
    return level.select(*KEY, F.col("_first.id").alias("_keep"), "_n")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_bits: int = 3
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The digests (about 80 bytes a document) are written once to the shared
    folder; the rounds and the final join read those, never the texts again.
    The join is a left join on the digest that adaptive execution may split
    on the document side, so a hot digest does not land in one task.
    """
    digests = materialize(digest_table(docs, id_col, text_col), "digests")
    if runs is None:
        last = digests.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0]
        runs = min(1 + (last or 0), MOST_RUNS)
    classes = merge_runs(digests, runs, fan_bits)
    return (
        digests.join(classes, KEY, "left")
        .select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_n").alias("group_size"),
            F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )
