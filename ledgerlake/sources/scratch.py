"""Tables that a job writes for its own later steps, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
MOST_BROADCAST = 200_000  # rows of a table that goes to all tasks


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and the master is local."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written once and read back: what follows starts from files, plans it
    in two places without computing it twice, and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_removed_at_end, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, name: str) -> DataFrame:
    """A table of a few rows a file, written once.  If it is as small as it should be it goes to all tasks, so that no
    join by file puts a file's rows into one task."""
    kept = written(df, name)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def _removed_at_end(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
