"""Manual reassignments and exclusions as append-only events.

Events have (txn_id, action, party, at): action is assign, exclude, restore or
reset.  The effective state of a transaction is a fold over its events; with the
latest event per kind it needs no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import dbl


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    best = F.max_by(F.struct(*[x for x in rows.columns if x not in keys]), F.struct(*order)).alias("_m")
    return rows.groupBy(*keys).agg(best).select(*keys, "_m.*").select(*rows.columns)


def effective_assignments(events: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """(keys, txn_id, party, status) in force: a reset removes what came before;
    excluding keeps the party; restoring only lifts an exclusion."""
    at = lambda *kinds: F.max(F.when(F.col("action").isin(*kinds), F.col("at")))
    per = events.groupBy(*keys, "txn_id").agg(
        at("reset").alias("reset_at"),
        at("assign").alias("assign_at"),
        at("exclude").alias("exclude_at"),
        at("restore", "assign").alias("lift_at"),
        F.max_by("party", F.when(F.col("action") == "assign", F.col("at"))).alias("party"),
    )
    return settled(per, list(keys))


def settled(per: DataFrame, keys: list[str]) -> DataFrame:
    """What is in force, from the last time of each kind of event."""
    reset = F.coalesce("reset_at", F.lit(-1))
    assigned = F.col("assign_at") > reset
    excluded = (F.col("exclude_at") > reset) & (F.col("exclude_at") > F.coalesce("lift_at", F.lit(-1)))
    return per.select(
        *keys,
        "txn_id",
        F.when(assigned, F.col("party")).alias("party"),
        F.when(F.coalesce(excluded, F.lit(False)), "excluded").when(assigned, "active").alias("status"),
    ).filter("status IS NOT NULL")


def hydrate(txns: DataFrame, assignments: DataFrame, parties: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Transactions with custom_party and excluded from the assignments in force
    and the names of the parties."""
    names = parties.select(*keys, F.col("party_id").alias("assigned_party_id"), F.col("name").alias("custom_party"))
    a = assignments.select(*keys, "txn_id", "assigned_party_id", "status").join(names, [*keys, "assigned_party_id"], "left")
    return txns.join(a, [*keys, "txn_id"], "left").select(
        *txns.columns, "custom_party", (F.coalesce("status", F.lit("")) == "excluded").alias("excluded")
    )


def party_totals(txns: DataFrame, assignments: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    active = assignments.filter("status = 'active' AND assigned_party_id IS NOT NULL")
    return (
        txns.join(active, [*keys, "txn_id"])
        .groupBy(*keys, F.col("assigned_party_id").alias("party_id"))
        .agg(F.count(F.lit(1)).alias("txn_count"), dbl(F.sum("debit")).alias("debit"), dbl(F.sum("credit")).alias("credit"))
    )


def party_list(parties: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return parties.join(totals, [*keys, "party_id"], "left").select(
        *keys,
        "party_id",
        "name",
        F.coalesce("txn_count", F.lit(0)).cast("long").alias("txn_count"),
        zero("debit").alias("debit"),
        zero("credit").alias("credit"),
        (zero("credit") - zero("debit")).alias("net"),
    )


def name_key(name: Column) -> Column:
    return F.upper(F.trim(name))


def party(parties: DataFrame, party_id: int) -> DataFrame:
    return parties.filter(F.col("party_id") == party_id)


def add_parties(parties: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """New names that no party has yet, whatever their case; blank ones are refused."""
    keyed = fresh.withColumn("_k", name_key(F.col("name"))).filter("_k IS NOT NULL AND _k != ''")
    once = latest(keyed, [*keys, "_k"], ["name"])
    known = parties.select(*keys, name_key(F.col("name")).alias("_k"))
    return parties.unionByName(once.join(known, [*keys, "_k"], "left_anti").drop("_k"), allowMissingColumns=True)


def rename_party(parties: DataFrame, party_id: int, name: str, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Refuses an empty name or one that another party has: nothing changes then."""
    taken = parties.filter((name_key(F.col("name")) == name.strip().upper()) & (F.col("party_id") != party_id)).select(*keys).distinct()
    free = parties.join(taken.withColumn("_taken", F.lit(True)), list(keys), "left")
    change = (F.col("party_id") == party_id) & F.col("_taken").isNull() & F.lit(bool(name.strip()))
    return free.select(*[F.when(change, F.lit(name.strip())).otherwise(F.col(c)).alias(c) if c == "name" else F.col(c) for c in parties.columns])


def delete_party(assignments: DataFrame, party_id: int, strategy: str = "reassign_unassigned") -> DataFrame:
    """What becomes of a deleted party's assignments: they lose the party
    (unassigned), active ones go (original), or become exclusions (exclude).
    No reference to the party is left behind."""
    if strategy not in ("reassign_unassigned", "reassign_original", "exclude"):
        strategy = "reassign_unassigned"
    mine = F.coalesce(F.col("assigned_party_id") == party_id, F.lit(False))
    rows = assignments
    if strategy == "reassign_original":
        rows = rows.filter(~(mine & (F.col("status") == "active")))
    status = F.when(mine, "excluded").otherwise(F.col("status")) if strategy == "exclude" else F.col("status")
    return rows.withColumn("status", status).withColumn("assigned_party_id", F.when(~mine, F.col("assigned_party_id")))


def bulk_events(txns: DataFrame, ids: DataFrame, action: str, party: str | None, at: int, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Events for the ids that exist; others are dropped."""
    known = ids.join(txns.select(*keys, "txn_id"), [*keys, "txn_id"])
    return known.select(*keys, "txn_id", F.lit(action).alias("action"), F.lit(party).cast("string").alias("party"), F.lit(at).cast("long").alias("at"))


def audit_log(events: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """What each event changed, newest first by at."""
    w = Window.partitionBy(*keys, "txn_id").orderBy("at")
    verb = F.when(F.col("action") == "assign", "transaction_reassigned").when(F.col("action") == "exclude", "transaction_excluded").when(
        F.col("action") == "restore", "transaction_restored"
    ).otherwise("transaction_reset")
    return events.select(*keys, "txn_id", verb.alias("audit_action"), F.lag("party", 1).over(w).alias("before"), F.col("party").alias("after"), "at")


def apply_resolver(txns: DataFrame, rows: DataFrame) -> DataFrame:
    """Results of an external resolver by transaction; ledger Others and
    confidence 75 where it says nothing; unknown ids and names are dropped."""
    usable = rows.filter("party IS NOT NULL AND trim(party) NOT IN ('', 'UNRECOGNIZED')")
    allowed = usable.join(txns.select("txn_id"), "txn_id", "left_semi")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.upper("party"), r"[^A-Z0-9\s.&]", " "), r"\s+", " "))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(F.coalesce(dbl(F.col("confidence")), F.lit(75.0)) + 0.5)))
    made = allowed.select(
        "txn_id", clean.alias("ai_party"), F.coalesce(F.nullif(F.trim("ledger"), F.lit("")), F.lit("Others")).alias("ai_ledger"), confidence.cast("double").alias("ai_confidence")
    )
    return txns.join(made, "txn_id", "left")


def party_options(parties: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Names to choose from: the parties, and detected labels that no party has, whatever their case."""
    known = parties.select(*keys, F.lower(F.trim("name")).alias("_k"))
    detected = labels.select(*keys, F.col("label").alias("name"), F.lower(F.trim("label")).alias("_k")).filter("_k NOT IN ('', 'unrecognized')")
    once = detected.groupBy(*keys, "_k").agg(F.min("name").alias("name"))
    return parties.select(*keys, "name").unionByName(once.join(known, [*keys, "_k"], "left_anti").select(*keys, "name"))
