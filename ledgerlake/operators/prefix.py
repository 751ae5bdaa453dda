"""Running numbers and sums over long groups without one task per group.

A group's rows are cut into ordered buckets (months, say).  Numbers and sums run
inside a bucket, in parallel; what came before a bucket is a running sum over one
row per bucket.  A group of any size so spreads over as many tasks as buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are made once a row: filters and columns after it take them as they are (the planner would
    put what makes them into each of these)."""
    each = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))
    return df.select("*", each.alias("_made")).select(*df.columns, *[f"_made.{n}" for n in made])


def keyed(df: DataFrame, named: dict[str, Column]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Adds columns that are equal where the named ones are, null to null, and are never null: rows parted by them can be
    joined on them as they lie, which a null-safe join cannot.  Returns their names by name."""
    found: dict[str, list[str]] = {}
    schema = df.select(*[c.alias(n) for n, c in named.items()]).schema
    for n, c in named.items():
        kind = schema[n].dataType
        if not schema[n].nullable:
            df, found[n] = df.withColumn(f"_q_{n}", c), [f"_q_{n}"]
        elif isinstance(kind, T.DateType):
            df, found[n] = df.withColumn(f"_q_{n}", F.coalesce(F.unix_date(c), F.lit(-(1 << 31)))), [f"_q_{n}"]
        elif isinstance(kind, T.StringType):
            df, found[n] = df.withColumn(f"_q_{n}", F.coalesce(c, F.lit(""))).withColumn(f"_q0_{n}", c.isNotNull()), [f"_q0_{n}", f"_q_{n}"]
        elif isinstance(kind, (T.IntegralType, T.DecimalType)):
            df, found[n] = df.withColumn(f"_q_{n}", F.coalesce(c, F.lit(0).cast(kind))).withColumn(f"_q0_{n}", c.isNotNull()), [f"_q0_{n}", f"_q_{n}"]
        else:
            df, found[n] = df.withColumn(f"_q_{n}", F.struct(c)), [f"_q_{n}"]
    return df, found


def unkeyed(name: str, keys: list[str], kind: T.DataType) -> Column:
    """The column that keyed took its columns from (of text and whole numbers)."""
    return F.when(F.col(keys[0]), F.col(keys[1])).cast(kind).alias(name)


def running(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], number: str, sums: dict[str, Column]
) -> DataFrame:
    """Adds the row number in the group and running sums, rows up to and with this one.

    The rows are shuffled once: the offsets, one row a bucket, come to where the rows lie."""
    cut, keys = keyed(df, {**{g: F.col(g) for g in group}, "_bucket": bucket})
    by_group = [k for g in group for k in keys[g]]
    by_bucket = keys["_bucket"]
    on = [*by_group, *by_bucket]
    given = {g: df.schema[g].dataType for g in group if len(keys[g]) == 2}  # made again from its keys, so a text travels once
    totals = cut.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by_group).orderBy(*by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *on,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in sums],
    )
    inside = Window.partitionBy(*on).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = cut.withColumn("_k", F.row_number().over(inside))
    for n, c in sums.items():
        here = here.withColumn(f"_r_{n}", F.sum(c).over(upto))
    joined = here.drop(*given).join(offsets, on)
    return joined.select(
        *[unkeyed(x, keys[x], given[x]) if x in given else F.col(x) for x in df.columns],
        (F.col("_n0") + F.col("_k")).cast("long").alias(number),
        *[(F.col(f"_s0_{n}") + F.col(f"_r_{n}")).cast("decimal(18,2)").alias(n) for n in sums],
    )


def counted(rows: DataFrame, group: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """seq as the number of a row in its group where it is a struct of what orders a day's rows.

    The rows should be cheap to read twice (written)."""
    kind = rows.schema["seq"].dataType
    if not isinstance(kind, T.StructType):
        return rows
    order = ["txn_date", *[F.col("seq")[f] for f in kind.fieldNames()]]
    return running(rows, list(group), F.trunc("txn_date", "month"), order, "_seq", {}).drop("seq").withColumnRenamed("_seq", "seq")
