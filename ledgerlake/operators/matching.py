"""A manual ledger matched to a computed one, one to one.

Two entries may be one party if the first ten characters of one name occur in the other, or if
two words of four letters and more contain each other.  Such pairs share four letters in a
row, so candidates come from an equi-join on pieces, and the rule judges them.  Pairs
are weighed by name first and amount next; in each round every pair that is the best one left for both of
its sides is taken, until none is left: the result is that of taking pairs from the best
to the worst, and no two entries would both be better off with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

PREFIX = 10
PIECE = 4


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"[^A-Z0-9 ]", " "), r"\s+", " "))


def long_words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) > 3))


def overlap(a: Column, b: Column) -> Column:
    """How many long words of a contain a long word of b, or lie in one."""
    return F.size(F.filter(long_words(a), lambda x: F.exists(long_words(b), lambda y: x.contains(y) | y.contains(x))))


def begins_in(a: Column, b: Column) -> Column:
    """Whether the beginning of one name occurs in the other."""
    return b.contains(F.left(a, F.lit(PREFIX))) | a.contains(F.left(b, F.lit(PREFIX)))


def _pieces(key: Column) -> Column:
    """All stretches of up to four characters: four, or fewer for what begins a shorter name."""
    runs = lambda k: F.when(F.length(key) >= k, F.transform(F.sequence(F.lit(1), F.length(key) - (k - 1)), lambda i: F.substr(key, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(k) for k in range(1, PIECE + 1)]))


def _starts(key: Column) -> Column:
    """The first piece of the name and of each long word."""
    return F.array_distinct(F.concat(F.array(F.left(key, F.lit(PIECE))), F.transform(long_words(key), lambda w: F.left(w, F.lit(PIECE)))))


def candidates(manual: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, c): pairs of names that the rule allows."""
    m = manual.select(*keys, F.col("key").alias("m")).distinct()
    k = computed.select(*keys, F.col("key").alias("c")).distinct()
    asks = lambda df, name: df.select(*keys, name, F.explode(_starts(F.col(name))).alias("piece"))
    holds = lambda df, name: df.select(*keys, name, F.explode(_pieces(F.col(name))).alias("piece"))
    met = asks(m, "m").join(holds(k, "c"), [*keys, "piece"]).select(*keys, "m", "c").unionByName(holds(m, "m").join(asks(k, "c"), [*keys, "piece"]).select(*keys, "m", "c")).distinct()
    return met.filter(begins_in(F.col("m"), F.col("c")) | (overlap(F.col("m"), F.col("c")) >= 2))


def assigned(manual: DataFrame, computed: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """(keys, manual_id, computed_id, round) for entries (keys, id, name, amount) of both ledgers.

    Better pairs: the beginning of a name in the other, more words in common, a smaller difference of
    amounts, the smaller identifiers.  Entries without a name match nothing."""
    by = list(keys)
    named = lambda df: df.select(*by, "id", name_key(F.col("name")).alias("key"), F.col("amount").cast("double").alias("amount")).filter("key <> ''")
    left, right = written(named(manual), "match-manual"), written(named(computed), "match-computed")
    pairs = candidates(left, right, by)
    one = left.select(*by, F.col("id").alias("manual_id"), F.col("key").alias("m"), F.col("amount").alias("ma"))
    two = right.select(*by, F.col("id").alias("computed_id"), F.col("key").alias("c"), F.col("amount").alias("ca"))
    full = pairs.join(one, [*by, "m"]).join(two, [*by, "c"])
    off = F.coalesce(F.abs(F.col("ma") - F.col("ca")), F.lit(float("inf")))
    worse = F.struct((~begins_in(F.col("m"), F.col("c"))).alias("apart"), (-overlap(F.col("m"), F.col("c"))).alias("words"), off.alias("off"), "manual_id", "computed_id")
    left_over = written(full.select(*by, "manual_id", "computed_id", worse.alias("worse")), "match-pairs")
    done, turn = None, 0
    while True:
        best_m = left_over.groupBy(*by, "manual_id").agg(F.min("worse").alias("worse"))
        best_c = left_over.groupBy(*by, "computed_id").agg(F.min("worse").alias("worse"))
        taken = best_m.join(best_c, [*by, "worse"]).select(*by, "manual_id", "computed_id", F.lit(turn).alias("round"))
        taken = written(taken, "match-taken")
        done = taken if done is None else done.unionByName(taken)
        if taken.isEmpty():
            return done
        left_over = left_over.join(taken.select(*by, "manual_id"), [*by, "manual_id"], "left_anti").join(taken.select(*by, "computed_id"), [*by, "computed_id"], "left_anti")
        left_over = written(left_over, "match-pairs")
        turn += 1
