"""Party resolution over distinct narrations, clustering and the party ledger."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as c
from ..functions import names
from ..sources.scratch import written
from .clustering import clustered
from .metrics import dbl

TEXTS = ("narration", "party", "custom_party", "ai_party", "ai_ledger", "ai_confidence", "excluded", "label")
RESOLVED = T.StructType(
    [T.StructField(n, T.IntegerType() if n == "confidence" else T.StringType()) for n in names.Resolved._fields]
)


def told(party: pa.Array, narration: pa.Array) -> tuple[list[names.Resolved], pa.Array]:
    """What the different texts of a batch tell, and the place of each row's in it."""
    coded = [x.dictionary_encode(null_encoding="encode") for x in (party, narration)]
    a, b = (x.dictionary.to_pylist() for x in coded)
    at = [x.indices.to_numpy(zero_copy_only=False).astype("int64") for x in coded]
    pairs, place = np.unique(at[0] * len(b) + at[1], return_inverse=True)
    return [names.resolved(a[k // len(b)] or "", b[k % len(b)] or "") for k in pairs.tolist()], pa.array(place.astype("int32"))


@F.arrow_udf(RESOLVED)
def resolved(party: pa.Array, narration: pa.Array) -> pa.Array:
    """A transaction's texts through the extraction ladder.  Workers remember the
    texts they have seen, so nothing is shuffled to find the distinct ones; a
    batch sends each text's result once and repeats it by its place."""
    found, place = told(party, narration)
    columns = list(zip(*found)) or [()] * len(RESOLVED)
    kinds = [pa.int32() if f.name == "confidence" else pa.string() for f in RESOLVED]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], RESOLVED.fieldNames()).take(place)


@F.arrow_udf(T.StringType())
def resolved_label(party: pa.Array, narration: pa.Array) -> pa.Array:
    """The label alone, for plans that show nothing else of what the texts tell."""
    found, place = told(party, narration)
    return pa.array([x.label for x in found], pa.string()).take(place)


@F.pandas_udf(T.StringType())
def segment_party(narration: pd.Series) -> pd.Series:
    """The party that the fields of a narration name, by themselves."""
    return narration.map(lambda x: names.best_segment(x) if isinstance(x, str) else None)


def normalized_name(name: Column) -> Column:
    """Canonical form of a name given by a user or a resolver, never cut."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: names.normalized(x, capped=False) if isinstance(x, str) else None)

    return run(name)


def with_party(txns: DataFrame) -> DataFrame:
    """Transactions with label, confidence, category, fine mode and party type.

    Optional columns party, custom_party, ai_party, ai_ledger, ai_confidence and
    excluded are taken as null if missing.  A user's party comes first, then a
    resolver's, then what the narration tells.
    """
    return described(named(txns))


def given_names() -> tuple[Column, Column]:
    """The party a user gave, and the one a resolver gave."""
    return tuple(F.nullif(F.trim(x), F.lit("")) for x in ("custom_party", "ai_party"))


def label_of(said: Column) -> Column:
    """The label of a given party, else what the texts say."""
    given = F.coalesce(*given_names())
    return F.when(given.isNotNull(), normalized_name(given)).otherwise(said)


def optional(txns: DataFrame) -> DataFrame:
    """The optional columns as null where they are missing."""
    have = set(txns.columns)
    for name, kind in (("party", "string"), ("custom_party", "string"), ("ai_party", "string"), ("ai_ledger", "string"), ("ai_confidence", "double"), ("excluded", "boolean")):
        if name not in have:
            txns = txns.withColumn(name, F.lit(None).cast(kind))
    return txns


def named(txns: DataFrame) -> DataFrame:
    """Transactions with what their names give; what follows from it by rules is in described."""
    txns = optional(txns)
    joined = txns.withColumn("_found", resolved("party", "narration"))
    custom, ai = given_names()
    given = F.coalesce(custom, ai)
    label = label_of(F.col("_found.label"))
    ai_confidence = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.nullif("ai_confidence", F.lit(0.0)), F.lit(90.0))))
    return joined.select(
        *[x for x in txns.columns if x not in ("label",)],
        F.coalesce(given, F.col("_found.entity")).alias("party_name"),
        label.alias("label"),
        F.when(custom.isNotNull(), 100.0).when(ai.isNotNull(), ai_confidence).otherwise(dbl(F.col("_found.confidence"))).alias("confidence"),
        custom.alias("manual_party"),
        F.col("_found.label").alias("_said"),
        F.col("_found.alias").alias("narration_alias"),
        F.col("_found.alias_label").alias("alias_label"),
    )


def described(rows: DataFrame) -> DataFrame:
    """Named rows with category, fine mode and party type.  They come after the names are
    written, so that a plan pays for those it uses only."""
    custom, ai = given_names()
    party, fine = (F.col("_said"), F.col("category"), F.col("narration")), (F.col("mode"), F.col("narration"))
    texts = {"_party_text": c.party_text(*party), "_fine_text": c.upper_text(*fine)}
    cat = (
        F.when(custom.isNotNull(), "USER ASSIGNED")
        .when(ai.isNotNull(), F.upper(F.coalesce(F.nullif("ai_ledger", F.lit("")), F.lit("AI ASSIGNED"))))
        .otherwise(c.party_category(*party, F.col("_party_text")))
    )
    last = ("manual_party", "_said", "narration_alias", "alias_label")
    return rows.withColumns(texts).select(
        *[x for x in rows.columns if x not in last],
        cat.alias("party_category"),
        c.fine_mode(*fine, F.col("_fine_text")).alias("fine_mode"),
        "manual_party",
        F.when(custom.isNotNull(), "person").otherwise(c.party_type(F.col("label"), F.col("confidence"))).alias("txn_party_type"),
        "narration_alias",
        "alias_label",
    )


def cluster_names(resolved: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, label, canonical) of the distinct labels of each analysis, with the
    place they were first seen as their order (see operators.clustering)."""
    said = resolved.filter("manual_party IS NULL").select(*keys, "label", "txn_date", "seq")
    day = said.groupBy(*keys, "label").agg(F.min("txn_date").alias("_day"))  # a hash aggregate; structs would be sorted, all rows of them
    day = written(day, "label-days").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate((*keys, "label"))], "_day")
    on = [said[k].eqNullSafe(day[f"_k{i}"]) for i, k in enumerate((*keys, "label"))] + [said["txn_date"].eqNullSafe(day["_day"])]
    labels = said.join(day, on).groupBy(*keys, "label").agg(F.min(F.struct("txn_date", "seq")).alias("_first"))
    return written(clustered(labels, keys, ("_first",)), "cluster-shown")


def party_rows(txns: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Included transactions with the party they are filed under.  The resolved rows
    are written once: labels and rows come from the same pass over the narrations.  Rows without mode
    and category are filed only, and come without their texts."""
    if not {"mode", "category"} <= set(txns.columns):
        rows, shown = labelled_rows(txns, tuple(x for x in txns.columns if x not in TEXTS), keys)
        return filed(rows, shown, keys)
    resolved = described(written(named(txns).filter(~F.coalesce("excluded", F.lit(False))), "party-rows"))
    return filed(resolved, cluster_names(resolved, keys), keys)


def filed(rows: DataFrame, shown: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.join(shown, [*keys, "label"], "left").withColumn("filed_party", F.coalesce("manual_party", "canonical", "label"))


def labelled_rows(txns: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("account_id",)) -> tuple[DataFrame, DataFrame]:
    """Included transactions with their label and the columns that a plan uses, written once, and
    the party that each label is shown under (see filed)."""
    rows = optional(txns)
    custom, _ = given_names()
    rows = rows.withColumn("label", label_of(resolved_label("party", "narration"))).filter(~F.coalesce("excluded", F.lit(False)))
    rows = rows.select(*keys, "txn_date", "seq", "label", custom.alias("manual_party"), *[x for x in columns if x in txns.columns and x not in ("txn_date", "seq", *keys)])
    rows = written(rows, "label-rows")
    return rows, cluster_names(rows, keys)


def summarize(filed: DataFrame, keys: tuple[str, ...] = ("account_id",), party: str = "filed_party") -> DataFrame:
    """One row per party: counts, sums, modes, aliases, commonest category (the
    first seen of equals), mean confidence, type.

    Categories are counted first, so that a party with very many transactions
    reaches the final aggregation as a few rows."""
    own = F.when(F.col("manual_party").isNull() & (F.col("label") != F.col(party)), F.col("label"))
    said = F.when(
        F.col("manual_party").isNull() & (F.col("narration_alias") != F.col(party)) & (F.col("alias_label") == F.col(party)), F.col("narration_alias")
    )
    part = filed.groupBy(*keys, party, "party_category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("debit").alias("debit"),
        F.sum("credit").alias("credit"),
        F.collect_set("fine_mode").alias("modes"),
        F.collect_set(own).alias("a1"),
        F.collect_set(said).alias("a2"),
        F.sum("confidence").alias("confidence"),
        F.min(F.struct("txn_date", "seq")).alias("first"),
    )
    least = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))))
    whole = part.groupBy(*keys, party).agg(
        F.sum("n").alias("txn_count"),
        dbl(F.sum("debit")).alias("debit"),
        dbl(F.sum("credit")).alias("credit"),
        dbl(F.sum("credit") - F.sum("debit")).alias("net"),
        least("modes").alias("modes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("a1", "a2"))))).alias("aliases"),
        F.max_by("party_category", F.struct(F.col("n"), -F.unix_date("first.txn_date"), -F.col("first.seq"))).alias("category"),
        F.floor(F.sum("confidence") / F.sum("n") + 0.5).cast("long").alias("confidence"),
        F.min("first").alias("first_seen"),
    )
    return whole.select(*keys, F.col(party).alias("party"), "txn_count", "debit", "credit", "net", "modes", "aliases", "category", "confidence",
                        c.party_type(F.col(party), F.col("confidence")).alias("party_type"), "first_seen")


def party_ledger(txns: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    return summarize(party_rows(txns, keys), keys)


def ranked(summary: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """The order of the report: most transactions, then largest turnover, then first seen."""
    w = Window.partitionBy(*keys).orderBy(F.desc("txn_count"), F.desc(F.col("debit") + F.col("credit")), "first_seen")
    return summary.withColumn("rank", F.row_number().over(w))
