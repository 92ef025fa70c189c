"""Deterministic sampling: every draw is a hash of keys, so reruns and retries agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C


def least_hash(df: DataFrame, n: int, *, by: list[str], key: list[str], seed: str) -> DataFrame:
    """The n rows of least hash in each group."""
    h = C.hash32(C.key_of(seed, *[F.col(k) for k in key]))
    w = Window.partitionBy(*by).orderBy("__h", *key)
    return df.withColumn("__h", h).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__h", "__n")


def stratified_split(df: DataFrame, fraction: float, *, by: list[str], key: list[str], seed: str) -> DataFrame:
    """Adds ``part``: floor(n * fraction) rows of each stratum go to val, at least one on each side if n > 1."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    cut = F.when(n > 1, F.least(F.greatest(F.floor(n * fraction), F.lit(1)), n - 1)).otherwise(0)
    h = C.hash32(C.key_of(seed, *[F.col(k) for k in key]))
    return df.withColumn("__h", h).withColumn("__r", F.row_number().over(w.orderBy("__h", *key))).withColumn("part", F.when(F.col("__r") <= cut, "val").otherwise("train")).drop("__h", "__r")


def proportional(df: DataFrame, n: int, *, by: list[str], weight: str, key: list[str], seed: str) -> DataFrame:
    """n rows of each group without replacement, with chances in proportion to the weight: least -ln(u) / weight."""
    u = (C.hash32(C.key_of(seed, *[F.col(k) for k in key])) + 1) / F.lit(4294967297.0)
    e = df.where(F.col(weight) > 0).withColumn("__e", F.round(-F.ln(u) / F.col(weight), 9))
    return e.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("__e", *key))).where(F.col("__n") <= n).drop("__e", "__n")


def largest_remainder(counts: DataFrame, total: int, *, bin_: str, count: str) -> DataFrame:
    """quota of each bin: floors of the exact shares, then the largest remainders get one more; never above the count.

    For a table of bins, which is small by its nature.
    """
    every = Window.partitionBy()
    exact = F.col(count) * F.lit(float(total)) / F.sum(count).over(every)
    c = counts.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    c = c.withColumn("__left", F.lit(total) - F.sum("__floor").over(every))
    order = Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), bin_)
    quota = F.least(F.col(count), F.col("__floor") + (F.row_number().over(order) <= F.col("__left")).cast("long"))
    return c.withColumn("quota", quota).drop("__exact", "__floor", "__left")


def by_quota(df: DataFrame, quotas: DataFrame, *, bin_: str, key: list[str], seed: str) -> DataFrame:
    """As many rows of each bin as its quota says, by least hash."""
    h = C.hash32(C.key_of(seed, *[F.col(k) for k in key]))
    r = df.join(F.broadcast(quotas.select(bin_, "quota")), bin_).withColumn("__h", h)  # one row a bin
    return r.withColumn("__n", F.row_number().over(Window.partitionBy(bin_).orderBy("__h", *key))).where(F.col("__n") <= F.col("quota")).drop("__h", "__n", "quota")


def prefix_galleries(sequence: DataFrame, sizes: list[int], *, by: list[str], order: list[str]) -> DataFrame:
    """Nested galleries: size N holds the first N - 1 of the sequence in slots 1.., slot 0 being the positive's."""
    ranked = sequence.withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("slot") <= max(sizes) - 1)
    return ranked.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("slot") <= s - 1)))


def block_sample(df: DataFrame, row: str, block: int, n: int, seed: str) -> DataFrame:
    """Whole blocks of consecutive rows in hash order until n rows are reached; the last block is cut.

    Blocks are first counted by the leading bits of their hash; only those of the leading part that reaches n are put in order.
    """
    b = F.floor(F.col(row) / block)
    sizes = df.groupBy(b.alias("__b")).agg(F.count("*").alias("__size")).withColumn("__h", C.hash32(C.key_of(seed, F.col("__b"))))
    part = F.floor(F.col("__h") / (1 << 20))
    parts = sizes.groupBy(part.alias("__part")).agg(F.sum("__size").alias("__rows"))  # 4,096 rows at most
    upto = F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    led = parts.withColumn("__led", F.coalesce(upto, F.lit(0))).where(F.col("__led") < n)
    order = Window.partitionBy("__part").orderBy("__h", "__b").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("__part", part).join(F.broadcast(led), "__part").withColumn("__before", F.col("__led") + F.coalesce(F.sum("__size").over(order), F.lit(0))).where(F.col("__before") < n)
    r = df.withColumn("__b", b).join(chosen, "__b").withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(row)))
    return r.where(F.col("__before") + F.col("__k") <= n).select(*df.columns)


def circular_shift(df: DataFrame, shift: int, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``shifted``: the value of the row ``shift`` places on, around the end of its group."""
    w = Window.partitionBy(*by)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    other = r.select(*by, F.col("__r").alias("__t"), F.col(value).alias("shifted"))
    return r.withColumn("__t", F.pmod(F.col("__r") + shift, F.col("__n"))).join(other, [*by, "__t"]).drop("__r", "__n", "__t")


def batches(df: DataFrame, size: int, *, by: list[str], key: list[str], seed: str) -> DataFrame:
    """Adds ``batch``: rows of each stratum in hash order, ``size`` to a batch."""
    h = C.hash32(C.key_of(seed, *[F.col(k) for k in key]))
    return df.withColumn("__h", h).withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("__h", *key)) - 1) / size).cast("long")).drop("__h")
