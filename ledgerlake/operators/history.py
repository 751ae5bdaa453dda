"""The override store through time: a log of events, snapshots of it, and its state at any time.

The state of a transaction follows from the last event of each kind (operators.overrides), and the
last of two stretches of a log is the later one: snapshots hold these, and advance by
an aggregate over what came after.  A batch that is written twice changes nothing: events
are known by account and sequence number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .overrides import settled

KINDS = {"reset_at": ("reset",), "assign_at": ("assign",), "exclude_at": ("exclude",), "lift_at": ("restore", "assign")}


def merged(log: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """The log with the events of a batch that it does not have; of equal numbers the log's event stays, of a
    batch's own repeated numbers one."""
    fresh = batch.dropDuplicates([*keys, "seq"]).join(log.select(*keys, "seq"), [*keys, "seq"], "left_anti")
    return log.unionByName(fresh.select(*log.columns))


def folded(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, txn_id, last time of each kind, party, upto): what a stretch of the log leaves."""
    last = {name: F.max(F.when(F.col("action").isin(*kinds), F.col("at"))) for name, kinds in KINDS.items()}
    party = F.max_by("party", F.when(F.col("action") == "assign", F.struct("at", "seq")))
    return events.groupBy(*keys, "txn_id").agg(*[x.alias(n) for n, x in last.items()], party.alias("party"), F.max("seq").alias("upto"))


def put_after(states: DataFrame, keys: list[str]) -> DataFrame:
    """Several stretches of one log into one."""
    party = F.max_by("party", F.when(F.col("assign_at").isNotNull(), F.struct("assign_at", "upto")))
    return states.groupBy(*keys, "txn_id").agg(*[F.max(n).alias(n) for n in KINDS], party.alias("party"), F.max("upto").alias("upto"))


def advanced(snapshot: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """A snapshot with the events after it.  It holds everything up to the largest number of its account, so
    only later events are read; the log may hold any part of the past."""
    by = list(keys)
    known = snapshot.groupBy(*by).agg(F.max("upto").alias("_upto"))
    fresh = log.join(known, by, "left").filter(F.col("seq") > F.coalesce("_upto", F.lit(-1))).drop("_upto")
    return put_after(snapshot.unionByName(folded(fresh, by)), by)


def snapshots_at(log: DataFrame, times: list[int], keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """(taken_at, keys, txn_id, state...): the state of all transactions at each of the times, from one pass:
    each event is folded into the stretch between two times, stretches are put together in order."""
    by = list(keys)
    times = sorted(set(times))
    stretch = F.array_position(F.transform(F.array(*[F.lit(x) for x in times]), lambda x: x >= F.col("at")), F.lit(True))
    parts = folded(log.withColumn("_s", stretch).filter("_s > 0"), [*by, "_s"])
    each = parts.withColumn("_t", F.explode(F.sequence(F.col("_s"), F.lit(len(times)).cast("long"))))
    whole = put_after(each.drop("_s"), [*by, "_t"])
    return whole.withColumn("taken_at", F.element_at(F.array(*[F.lit(x) for x in times]), F.col("_t").cast("int"))).drop("_t")


def as_of(snapshots: DataFrame, log: DataFrame, asks: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """(keys, ask_at, txn_id, party, status): assignments in force at the times of asks (keys, ask_at).

    An ask starts from the last snapshot not after it, found by an as-of window over both, and adds
    only the events between."""
    by = list(keys)
    marks = snapshots.select(*by, "taken_at").distinct().select(*by, F.col("taken_at").alias("t"), F.lit(0).alias("ask"))
    both = marks.unionByName(asks.select(*by, F.col("ask_at").alias("t"), F.lit(1).alias("ask")).distinct())
    past = Window.partitionBy(*by).orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    begun = both.withColumn("taken_at", F.max(F.when(F.col("ask") == 0, F.col("t"))).over(past)).filter("ask = 1").select(*by, F.col("t").alias("ask_at"), "taken_at")
    base = begun.join(snapshots, [*by, "taken_at"]).drop("taken_at")
    after = begun.join(log, by).filter((F.col("at") <= F.col("ask_at")) & (F.col("at") > F.coalesce("taken_at", F.lit(-(1 << 62)))))
    state = put_after(base.unionByName(folded(after, [*by, "ask_at"])), [*by, "ask_at"])
    return settled(state, [*by, "ask_at"])


STORED = T.StructType([T.StructField(n, T.StringType() if n in ("txn_id", "action", "party") else T.LongType()) for n in ("seq", "txn_id", "action", "party", "at")])
STORE = T.StructType([T.StructField("events", T.ArrayType(STORED))])


def read_stores(spark: SparkSession, folder: str) -> DataFrame:
    """(analysis_id, seq, txn_id, action, party, at) of the stores in a folder, one JSON file an
    analysis, named by it; what cannot be read is an empty store."""
    files = spark.read.option("wholetext", "true").text(f"{folder}/*.json").select(F.col("value"), F.col("_metadata.file_name").alias("name"))
    store = F.from_json("value", STORE, {"mode": "PERMISSIVE"})
    rows = files.select(F.regexp_replace("name", r"\.json$", "").alias("analysis_id"), F.explode(F.coalesce(store["events"], F.array().cast(T.ArrayType(STORED)))).alias("e"))
    return rows.select("analysis_id", "e.*")


def store_name(analysis_id: str) -> str:
    """The file of an analysis: letters, digits, _ and - stay."""
    return "".join(x if x.isascii() and (x.isalnum() or x in "_-") else "_" for x in analysis_id) + ".json"
