"""Places in one order over a whole table, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, *, bucket: Column, order: list[str], dense: bool = False) -> DataFrame:
    """Adds ``position`` (from 0) and ``total``: the row's place by ``order``, or with ``dense`` that of its value.

    ``bucket`` is a whole number that never falls along the order; nulls come first.  Rows are ranked inside their
    bucket, and the rows (values) of the buckets before are added: only a row a bucket goes through one task.
    """
    b = df.withColumn("__bucket", F.coalesce(bucket.cast("long"), F.lit(-(2**63))))
    units = b.select("__bucket", *order).distinct() if dense else b
    sizes = units.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    place = (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return b.withColumn("__place", place).join(sizes, "__bucket").withColumn("position", F.col("__before") + F.col("__place")).drop("__bucket", "__place", "__before")


def ntile(n: int, position: Column, total: Column) -> Column:
    """Bin 1..n of a position, as SQL's ntile: the first total % n bins hold one row more."""
    small, more = F.floor(total / n), total % n
    long_rows = more * (small + 1)
    late = F.floor((position - long_rows) / F.greatest(small, F.lit(1))) + more
    return (F.when(position < long_rows, F.floor(position / (small + 1))).otherwise(late) + 1).cast("int")
