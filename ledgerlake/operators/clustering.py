"""Clustering of party names, account by account, without one task an account.

The rule is greedy and depends on order: keys of names stand from the longest label
to the shortest (equal lengths as first seen); a key that no earlier seed has taken is a
seed, takes every key like it, and shows the longest label among them; where
several seeds take a key, the last one is shown.

1. Candidate pairs come from blocks that no pair within the rule can miss: the
   rarest word of a key (all words must match, for keys of up to six words), the
   word of a one-word key, or the first word with a piece of the last.  Words that match by edit
   distance share a piece of three letters at an end, or any piece if they are long.
2. The rule itself (functions.names.similar_keys) judges each pair, both ways.
3. Which keys are seeds is the lexicographically first independent set of that
   directed graph.  It is found in rounds over all accounts at once: a key with an earlier seed
   before it is taken; a key with no undecided key before it is a seed.  Each
   round decides at least the first undecided key of every chain, mostly far more.
4. Members, labels to show and the last seed are aggregates.

The result equals functions.names.clusters for any order of the input.  Keys of more than
six words may match in part, so they are blocked by every word.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..sources.scratch import written

ALL_MATCH = 6  # up to so many words, 85 % of them are all of them
ENDS_DIFFER = 11  # words as long as this may have an edit at both ends


@F.pandas_udf(T.StringType())
def key_of(label: pd.Series) -> pd.Series:
    return label.map(names.cluster_key)


@F.pandas_udf(T.StringType())
def display_of(label: pd.Series) -> pd.Series:
    return label.map(names.display)


@F.pandas_udf(T.BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names.similar_keys(x, y) for x, y in zip(a, b)], dtype=bool)


def pieces(word: Column) -> Column:
    """What words that match, or that are a prefix or suffix of each other, share: the word,
    its first or last three letters, or (of long words) three letters anywhere."""
    size = F.length(word)
    ends = F.array(F.concat(F.lit("<"), F.substring(word, 1, 3)), F.concat(F.lit(">"), F.right(word, F.lit(3))))
    inner = F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substr(word, i, F.lit(3)))
    short = F.when(size >= 3, ends).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("="), word)), short, F.when(size >= ENDS_DIFFER, inner).otherwise(F.array().cast("array<string>")))


def candidates(keys: DataFrame) -> DataFrame:
    """(_a, x, y): pairs of different keys, x < y, with all pairs that may be alike."""
    each = keys.select("_a", "key", F.split("key", " ").alias("w"))
    words = each.select("_a", "key", F.size("w").alias("n"), F.explode(F.array_distinct("w")).alias("word"))
    often = words.groupBy("_a", "word").agg(F.count(F.lit(1)).alias("often"))
    words = words.join(often, ["_a", "word"])
    rarest = Window.partitionBy("_a", "key").orderBy("often", "word")
    words = words.withColumn("place", F.row_number().over(rarest))
    asks = words.filter((F.col("place") == 1) | (F.col("n") > ALL_MATCH)).select("_a", "key", F.explode(pieces(F.col("word"))).alias("block"))
    holds = words.select("_a", "key", F.explode(pieces(F.col("word"))).alias("block"))
    tails = each.filter(F.size("w") >= 2).withColumn("head", F.get("w", F.lit(0)))
    said = lambda w: F.explode(F.transform(pieces(w), lambda p: F.concat_ws(" ", F.col("head"), p)))
    asks = asks.unionByName(tails.select("_a", "key", said(F.element_at("w", -1)).alias("block")))
    rest = tails.select("_a", "key", "head", F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("word"))
    holds = holds.unionByName(rest.select("_a", "key", said(F.col("word")).alias("block")))
    met = asks.distinct().join(holds.distinct().withColumnRenamed("key", "other"), ["_a", "block"]).filter("key <> other")
    return met.select("_a", F.least("key", "other").alias("x"), F.greatest("key", "other").alias("y")).distinct()


def edges(keys: DataFrame) -> DataFrame:
    """(_a, src, dst, src_place, dst_place): dst is like src, by the rule as seen from src."""
    pairs = candidates(keys.select("_a", "key"))
    both = pairs.select("_a", F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(pairs.select("_a", F.col("y").alias("src"), F.col("x").alias("dst")))
    found = both.filter(alike("src", "dst"))
    place = lambda name: keys.select("_a", F.col("key").alias(name), F.col("place").alias(f"{name}_place"))
    return found.join(place("src"), ["_a", "src"]).join(place("dst"), ["_a", "dst"])


def seeds(keys: DataFrame, found: DataFrame) -> DataFrame:
    """(_a, key) of the seeds: the first independent set in the order of places."""
    earlier = found.filter("src_place < dst_place").select("_a", "src", "dst")
    bound = earlier.select("_a", F.col("dst").alias("key")).distinct()
    chosen = keys.select("_a", "key").join(bound, ["_a", "key"], "left_anti")
    left = bound
    last = chosen
    while not left.isEmpty():
        taken = earlier.join(last.withColumnRenamed("key", "src"), ["_a", "src"]).select("_a", F.col("dst").alias("key")).distinct()
        left = written(left.join(taken, ["_a", "key"], "left_anti"), "cluster-left")
        earlier = written(
            earlier.join(left.withColumnRenamed("key", "src"), ["_a", "src"], "left_semi").join(left.withColumnRenamed("key", "dst"), ["_a", "dst"], "left_semi"), "cluster-edges"
        )
        last = written(left.join(earlier.select("_a", F.col("dst").alias("key")).distinct(), ["_a", "key"], "left_anti"), "cluster-seeds")
        left = left.join(last, ["_a", "key"], "left_anti")
        chosen = chosen.unionByName(last)
    return chosen


def clustered(labels: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """(keys, label, canonical) for labels (keys, label and the columns that order them)."""
    kind = F.struct(*keys).alias("_a")
    place = F.struct((-F.length("label")).alias("size"), *order, F.col("label").alias("said"))
    named = written(labels.select(kind, "label", key_of("label").alias("key"), place.alias("place")), "cluster-labels")
    first = written(named.groupBy("_a", "key").agg(F.min("place").alias("place")), "cluster-keys")
    found = written(edges(first), "cluster-alike")
    chosen = written(seeds(first, found), "cluster-all-seeds").withColumnRenamed("key", "src")
    own = first.join(chosen.withColumnRenamed("src", "key"), ["_a", "key"]).select(
        "_a", F.col("key").alias("src"), F.col("place").alias("src_place"), F.col("key").alias("dst"), F.col("place").alias("dst_place"), F.lit(0).alias("away")
    )
    took = own.unionByName(found.join(chosen, ["_a", "src"]).select("_a", "src", "src_place", "dst", "dst_place", F.lit(1).alias("away")))
    took = written(took, "cluster-members")
    longest = F.struct(F.col("dst_place.size").alias("size"), "away", "dst_place")
    shown = took.groupBy("_a", "src").agg(F.min_by(F.col("dst_place.said"), longest).alias("best"))
    last = took.groupBy("_a", F.col("dst").alias("key")).agg(F.max_by("src", "src_place").alias("src"))
    names_of = last.join(shown, ["_a", "src"]).select("_a", "key", display_of("best").alias("canonical"))
    out = named.join(names_of, ["_a", "key"])
    return out.select(*[F.col("_a")[k].alias(k) for k in keys], "label", "canonical")
