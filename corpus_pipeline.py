"""A cleaning pipeline over documents: each stage works on what the one before
kept, written as Parquet and read back in between.

1. language ID by compression: documents whose language is rejected go;
2. line dedup: later lines like an earlier one are cut out, and a document that
   loses its last line goes;
3. near-dedup: of each group of near duplicates the smallest identifier stays;
4. benchmark decontamination: contaminated documents go;
5. byte-level BPE: what is left is encoded, and decoded again as a check.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, decontam, langid, line_dedup, near_dedup
from ledgerlake.llm.common import materialize, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.learn(docs.filter(~langid.held_out()))
    known = langid.classify(docs, model, keep=docs.columns)
    return known.filter(~F.col("rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("_ld_removed") > 0) & (F.trim("text") == "")
    text_size = F.char_length("text").cast("long")
    out = done.filter(~emptied)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_ld_removed") > 0, text_size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: SQL cannot express compression, BagMinHash or merge replay; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
