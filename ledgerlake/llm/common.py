"""Shared plumbing of the training-data operators: scratch tables in the
shared folder, Arrow batch helpers and the tables of a data folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so fewer rows than the default make an Arrow batch; a
    smaller number already set stays."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf, "10000")) <= ARROW_ROWS:
        spark.conf.set(conf, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, to be handled in small Arrow batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset a temporary folder is taken, but only in local mode:
    on a cluster a machine-local folder would lose the table.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left there goes when the driver
    ends, if its session still runs then."""
    path = f"{shared_dir(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_end, spark, path)
    return path


def _remove_at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, release: bool = True, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later stages then
    start from files that survive a lost executor, and lineage is cut.  The
    shuffle files behind it are of no more use; a collection frees them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read any more."""
    for df in tables:
        remove_path(df.sparkSession, df._scratch_path)


BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, n_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its measured size is within the bound;
    beyond it the join stays a shuffle join."""
    return F.broadcast(df) if n_bytes <= most else df


PLACE_BITS = 33  # of monotonically_increasing_id, for the place in a partition


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``_i``, the place in the group from 0, and ``_n``, the group's size.

    The rows are sorted by range and written; what stands before a partition
    is a running sum over one row per partition and group."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = F.monotonically_increasing_id()
    run = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at), name, release=False)
    run = run.withColumn("_part", F.shiftrightunsigned("_at", PLACE_BITS))
    parts = run.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(
        parts.select(
            F.col("_part").alias("_p"),
            F.col(group).alias("_of"),
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(whole).alias("_n"),
        ),
        name + "-parts",
        release=False,
    )
    small = broadcast_if_small(parts, 100 * parts.count())
    found = run.join(small, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_of")))
    return found.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_i"), "_n")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Memories that a worker process keeps between tasks, as functions that forget them.
KEPT: dict[str, Callable[[], None]] = {}


def forget_others(uses: str) -> None:
    for name, forget in KEPT.items():
        if name != uses:
            forget()


def given_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator], uses: str = "") -> Callable[[Iterator], Iterator]:
    """A worker function that gives freed memory back to the system when its
    task ends: workers are kept, and share their node with the executor.  What a
    worker remembers for other operators than the one used here is forgotten first."""

    def wrapped(batches: Iterator) -> Iterator:
        forget_others(uses)
        yield from run(batches)
        given_back()

    return wrapped


def pieces_of(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about most_bytes each (one row
    at least), so that what a worker holds follows neither rows nor batch."""
    col = batch.column(column)
    sizes = pc.binary_length(col).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > most_bytes:
            yield start, i
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield start, len(sizes)


def column_of(batch_columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if c.type == f.type else c.cast(f.type) for c, f in zip(batch_columns, schema)], schema=schema
    )
