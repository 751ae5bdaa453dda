"""Result tables to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").partitionBy(*(by or []))
    {"parquet": writer.parquet, "json": writer.json, "csv": writer.option("header", True).csv}[kind](path)


def as_document(df: DataFrame, key: str) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("document"))


def export_name(holder: Column, bank: Column, suffix: Column, period: Column, most: int = 180) -> Column:
    """A file name of safe characters: holder, bank, last digits, period."""
    clean = lambda x: F.nullif(F.regexp_replace(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), F.lit(""))
    return F.left(F.concat_ws("_", clean(holder), clean(F.regexp_replace(F.initcap(bank), " ", "")), clean(suffix), clean(period)), F.lit(most))


def sheet_names(df: DataFrame, name: str) -> DataFrame:
    """Sheet names of at most 28 legal characters, numbered where they clash."""
    safe = F.left(F.trim(F.regexp_replace(F.col(name), r"[\\/*?:\[\]]", " ")), F.lit(28))
    w = Window.partitionBy(F.lower("sheet")).orderBy(name)
    n = F.row_number().over(w)
    return df.withColumn("sheet", safe).withColumn("sheet", F.when(n > 1, F.concat("sheet", F.lit(" "), n.cast("string"))).otherwise(F.col("sheet")))
