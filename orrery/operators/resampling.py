"""Resampling statistics with draws from key hashes, so that reruns, retries and other engines agree.

Draws are with replacement, as many of each group as it has rows.  A draw picks
rows by number; numbers and picks meet by a join, and only sums leave a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import hash32, key_of


def percentiles(samples: DataFrame, value: str, *, by: list[str], at: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """by, q0, q1, ...: the linear percentiles of the samples."""
    q = samples.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(x) for x in at])).alias("q"))
    return q.select(*by, *[F.col("q")[k].alias(f"q{k}") for k in range(len(at))])


def stratified_means(rows: DataFrame, *, stratum: str, key: str, value: str, draws: int, seed: str = "boot") -> DataFrame:
    """draw, macro: for each draw the mean over strata of the mean of a resample of each stratum."""
    w = Window.partitionBy(stratum)
    numbered = rows.select(F.col(stratum).alias("s"), F.col(value).alias("v"), (F.row_number().over(w.orderBy(key)) - 1).alias("k"), F.count("*").over(w).alias("n"))
    picks = numbered.select("s", "n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), "k")
    picks = picks.select("s", "draw", (hash32(key_of(seed, F.col("s"), F.col("draw"), F.col("k"))) % F.col("n")).cast("int").alias("k"))
    times = picks.groupBy("s", "draw", "k").agg(F.count("*").alias("times"))
    means = times.join(numbered, ["s", "k"]).groupBy("s", "draw").agg((F.sum(F.col("times") * F.col("v")) / F.max("n")).alias("m"))
    return means.groupBy("draw").agg(F.avg("m").alias("macro"))


def sign_flip_macro(rows: DataFrame, *, stratum: str, key: str, value: str, draws: int, seed: str = "flip") -> DataFrame:
    """observed, p: the mean over strata of their means, and its one-sided chance under random signs, (1 + extreme) / (1 + draws)."""
    real = rows.groupBy(stratum).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("observed"))
    sign = F.when(hash32(key_of(seed, F.col(stratum), F.col(key), F.col("draw"))) % 2 == 0, 1.0).otherwise(-1.0)
    flipped = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    means = flipped.groupBy(stratum, "draw").agg(F.avg(sign * F.col(value)).alias("m")).groupBy("draw").agg(F.avg("m").alias("m"))
    both = means.join(F.broadcast(real))  # one row
    return both.groupBy("observed").agg(((1 + F.count_if(F.col("m") >= F.col("observed") - 1e-12)) / F.lit(draws + 1.0)).alias("p"))


def axis_weights(panel: DataFrame, axis: str, draws: int, seed: str) -> DataFrame:
    """axis, draw, w: how often each value of the axis is drawn, in as many picks as it has values."""
    values = panel.select(axis).distinct()
    w = Window.partitionBy()
    numbered = values.select(axis, (F.row_number().over(Window.orderBy(axis)) - 1).alias("k"), F.count("*").over(w).alias("n"))  # a row a scenario or coordinate
    picks = numbered.select("n", "k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = picks.select("draw", (hash32(key_of(seed, axis, F.col("draw"), F.col("k"))) % F.col("n")).cast("int").alias("k"))
    return picks.groupBy("draw", "k").agg(F.count("*").alias("w")).join(numbered, "k").select(axis, "draw", "w")


def two_way(panel: DataFrame, *, scenario: str, coordinate: str, model: str, value: str, draws: int, seed: str = "two-way") -> DataFrame:
    """model, draw, m: means of resampled scenarios by resampled coordinates; all models share their draws.

    The panel has one row for each model, scenario and coordinate.
    """
    s = axis_weights(panel, scenario, draws, seed).withColumnRenamed("w", "ws")
    c = axis_weights(panel, coordinate, draws, seed).withColumnRenamed("w", "wc")
    w = F.col("ws") * F.col("wc")
    return panel.join(s, scenario).join(c, [coordinate, "draw"]).groupBy(model, "draw").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("m"))


def paired_deltas(samples: DataFrame, reference: str, *, model: str) -> DataFrame:
    """baseline, lo, hi, positive: interval of the reference's samples less each baseline's, draw by draw."""
    ref = samples.where(F.col(model) == reference).select("draw", F.col("m").alias("r"))
    d = samples.where(F.col(model) != reference).join(ref, "draw").select(F.col(model).alias("baseline"), (F.col("r") - F.col("m")).alias("delta"))
    share = d.groupBy("baseline").agg(F.avg((F.col("delta") > 0).cast("double")).alias("positive"))
    return percentiles(d, "delta", by=["baseline"]).join(share, "baseline").select("baseline", F.col("q0").alias("lo"), F.col("q1").alias("hi"), "positive")


def location_scale(df: DataFrame, column: str, *, by: list[str], use: str) -> DataFrame:
    """by, location, scale: median with IQR / 1.349 (``use`` iqr) or 1.4826 MAD (``use`` mad), else the deviation, else 1.

    Null and not finite values are left out.
    """
    x = df.where(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")))
    q = x.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop(column).alias("sd"))
    if use == "iqr":
        q = q.withColumn("spread", (F.col("q")[2] - F.col("q")[0]) / 1.349)
    else:
        away = x.join(q.select(*by, F.col("q")[1].alias("centre")), by)
        mad = away.groupBy(*by).agg((1.4826 * F.percentile(F.abs(F.col(column) - F.col("centre")), F.lit(0.5))).alias("spread"))
        q = q.join(mad, by)
    positive: Column = F.when(F.col("spread") > 1e-12, F.col("spread")).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return q.select(*by, F.col("q")[1].alias("location"), positive.alias("scale"))


def group_summary(df: DataFrame, column: str, *, by: list[str], group: str) -> DataFrame:
    """by, median of the groups' means, share of groups with a positive mean, number of groups."""
    g = df.groupBy(*by, group).agg(F.avg(column).alias("m"))
    return g.groupBy(*by).agg(F.percentile("m", F.lit(0.5)).alias("median"), F.avg((F.col("m") > 0).cast("double")).alias("positive"), F.count("*").alias("groups"))
