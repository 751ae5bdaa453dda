"""Statement documents, override stores, line tables and uploads as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import STATEMENTS

LINES = "file_id string, page_no int, line_no int, y double, text string, items array<struct<x:double,text:string>>"
ASSIGNMENTS = "account_id long, txn_id string, assigned_party_id long, status string, updated_at long"
PARTIES = "account_id long, party_id long, name string, is_manual boolean"
UPLOAD_BYTES = 25 << 20
PAGE_LIMIT = 40


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """JSON statement documents; broken ones come out as null rows and are dropped."""
    return spark.read.schema(STATEMENTS + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).filter("statements IS NOT NULL").drop("_corrupt_record")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSIGNMENTS).option("mode", "DROPMALFORMED").json(path)


def read_parties(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTIES).option("mode", "DROPMALFORMED").json(path)


def write_overrides(rows: DataFrame, path: str) -> None:
    """Replaces only the partitions of the accounts in rows."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("account_id").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES).json(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """PDF and image files with what they are; one beyond the size limit keeps its
    row, without content and with the reason."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext.isin("jpg", "jpeg", "png", "tif", "tiff"), "image")
    large = F.col("length") > UPLOAD_BYTES
    return files.select(
        "path", "modificationTime", "length", F.when(~large, F.col("content")).alias("content"), kind.alias("kind"), F.when(large, "file too large").alias("error")
    ).filter("kind IS NOT NULL")


def extract_lines(files: DataFrame, extractor) -> DataFrame:
    """Runs a plug-in, ``extractor(path, content) -> iterable of line rows``, over
    files; the plug-in must be safe to repeat, as tasks may be."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [r for p, content in zip(pdf["path"], pdf["content"]) for r in extractor(p, content)]
            yield pd.DataFrame(rows, columns=["file_id", "page_no", "line_no", "y", "text", "items"])

    return files.filter("content IS NOT NULL").select("path", "content").mapInPandas(run, LINES)


def with_fallback(first: DataFrame, second: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of the second source for files of which the first found nothing."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
