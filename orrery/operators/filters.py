"""Filters and scalar rules of observations and scores; each says what it does with nulls and values that aren't finite."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C

#: Width at half maximum of a unit Gaussian.
HALF_WIDTH = 2 * math.sqrt(2 * math.log(2))


def calibration(seeing: Column, depth: Column, sky: Column, *, pixel: float = 0.2) -> dict[str, Column]:
    """psf (pixels), zpt and skysig (counts a pixel) from the seeing, the five-sigma depth and the sky brightness."""
    sigma = seeing / F.lit(HALF_WIDTH)
    area = F.lit(4 * math.pi) * sigma * sigma
    zpt = 2 * depth - sky + 2.5 * F.log10(25 * area) + 2.5 * F.log10(1 + F.pow(F.lit(10.0), -0.4 * (depth - sky)) / area)
    return {"psf": sigma / F.lit(pixel), "zpt": zpt, "skysig": F.sqrt(F.pow(F.lit(10.0), -0.4 * (sky - zpt)) * F.lit(pixel * pixel))}


def shifted(t: Column, by: Column, valid: Column) -> Column:
    """Times of valid slots moved; others are 0."""
    return F.when(F.coalesce(valid, F.lit(False)), t + by).otherwise(0.0)


def without_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text doesn't begin with the prefix, whatever the case; null doesn't."""
    return df.where(~F.lower(F.coalesce(column, F.lit(""))).startswith(prefix.lower()))


def no_sentinel(x: Column, *, low: float = 0.0, high: float = 900_000.0) -> Column:
    """The value, or null if it is a sentinel: ``low`` or less, ``high`` or more, or not finite."""
    return F.when(C.finite(x) & (x > low) & (x < high), x)


def finite_rows(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns are all finite, one row n, usable, dropped)."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(C.finite(F.col(c)), F.lit(False))
    counts = df.agg(F.count("*").alias("n"), F.count_if(ok).alias("usable")).withColumn("dropped", F.col("n") - F.col("usable"))
    return df.where(ok), counts


def clean_photometry(df: DataFrame, *, object_: str, key: list[str], value: str, low: float, high: float, kind: str, mocks: list[str], least: int) -> DataFrame:
    """Distinct rows of ``key`` with a finite value in [low, high], without mocks, of objects with ``least`` rows left."""
    ok = C.finite(F.col(value)) & F.col(value).between(low, high) & ~F.col(kind).isin(mocks)
    rows = df.where(ok).select(*key).distinct()
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(object_))).where(F.col("__n") >= least).drop("__n")


def time_bias(dt: Column, *, weight: float, scale: float, power: float, most: float) -> Column:
    """-weight (|dt| / scale) ** power, no lower than -most; 0 for a time that isn't finite."""
    return F.when(C.finite(dt), F.greatest(F.lit(-most), -weight * F.pow(F.abs(dt) / scale, F.lit(power)))).otherwise(0.0)


def softmax(x: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def bucket(x: Column, edges: list[float], *, strict: bool = True) -> Column:
    """How many of the rising edges x is above (``strict``) or has reached."""
    out = F.lit(0)
    for e in edges:
        out = out + F.coalesce((x > e) if strict else (x >= e), F.lit(False)).cast("int")
    return out


def directional(a: Column, b: Column) -> dict[str, Column]:
    """interaction: the mean of two margins; wins: how many of them are positive, a tie being half."""
    win = lambda m: F.when(m > 0, 1.0).when(m < 0, 0.0).otherwise(0.5)
    return {"interaction": 0.5 * (a + b), "wins": 0.5 * (win(a) + win(b))}


def flux_of(magnitude: Column, zero_point: float = C.FLUXCAL_ZP) -> Column:
    return F.pow(F.lit(10.0), -0.4 * (magnitude - zero_point))


def as_mjd(day: Column) -> Column:
    """A Julian date as a modified one; smaller numbers are modified ones already."""
    return F.when(day > 2_400_000.5, day - 2_400_000.5).otherwise(day)


def reanchored(rows: DataFrame, parents: DataFrame, *, key: str, time: str, own: str, other: str) -> DataFrame:
    """Adds t: the row's time, moved from its own anchor to its parent's."""
    return rows.join(parents.select(key, F.col(other).alias("__to")), key).withColumn("t", F.col(time) + (F.col("__to") - F.col(own))).drop("__to")


def candidate_times(mode: Column, native: Column, shared: Column) -> Column:
    """Native times, zero, or the positive's for all."""
    return F.when(mode == "native", native).when(mode == "zero", 0.0).when(mode == "positive_shared", shared)


def in_window_or(dt: Column, most: float, synthetic: Column) -> Column:
    """A time difference inside the window, else the synthetic one."""
    return F.when(F.abs(dt) <= most, dt).otherwise(synthetic)


def standardised(x: Column, by: list[str]) -> Column:
    """(x - mean) / deviation in each group; 0 without deviation."""
    w = Window.partitionBy(*by)
    return F.when(F.stddev_pop(x).over(w) > 0, (x - F.avg(x).over(w)) / F.stddev_pop(x).over(w)).otherwise(0.0)


def of_large_groups(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups with ``least`` rows at least."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where(F.col("__n") >= least).drop("__n")


def first_ranked(df: DataFrame, k: int, *, by: list[str], order: list, name: str = "slot") -> DataFrame:
    """The first k rows of each group in an order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def shortlisted(df: DataFrame, *, by: list[str], first: list, most: int, then: list, k: int, parent: str | None = None) -> DataFrame:
    """The ``most`` first rows by one order, of these the k first by another; with ``parent``, one row of a parent, and rows
    beyond the shortlist fill up what is missing."""
    w = Window.partitionBy(*by)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(*first))).withColumn("__late", (F.col("__r") > most).cast("int"))
    if parent is None:
        r = r.where("__late = 0")
    else:
        r = r.withColumn("__p", F.row_number().over(Window.partitionBy(*by, parent).orderBy("__late", *then))).where("__p = 1")
    r = r.withColumn("__k", F.row_number().over(w.orderBy("__late", *then))).where(F.col("__k") <= k)
    return r.drop("__r", "__late", "__p", "__k")


def best_in_band(groups: DataFrame, rows: DataFrame, *, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """by, pick, level: the largest value inside the band (0), else the largest below it (1), else the least above it (2), else none (3)."""
    v = F.col(value)
    g = rows.groupBy(*by).agg(F.max(F.when(v.between(low, high), v)).alias("a"), F.max(F.when(v < low, v)).alias("b"), F.min(F.when(v > high, v)).alias("c"))
    j = groups.select(*by).distinct().join(g, by, "left")
    return j.select(*by, F.coalesce("a", "b", "c").alias("pick"), F.when(F.col("a").isNotNull(), 0).when(F.col("b").isNotNull(), 1).when(F.col("c").isNotNull(), 2).otherwise(3).alias("level"))


def nearest_bin(wanted: DataFrame, filled: DataFrame, *, bin_: str) -> DataFrame:
    """wanted bin, bin: the filled bin that is nearest, the lower of two; by one sort of both, no pairs."""
    from .intervals import nearest_before

    w, f = wanted.select(bin_).distinct(), filled.select(F.col(bin_).alias("there")).distinct()
    below = nearest_before(w.withColumn("g", F.lit(0)), f.select(F.lit(0).alias("g"), F.col("there").alias("at"), "there"), on=["g"], left_time=bin_, right_time="at")  # a row a bin
    up = nearest_before(w.withColumn("g", F.lit(0)).withColumn("__n", -F.col(bin_)), f.select(F.lit(0).alias("g"), (-F.col("there")).alias("at"), "there"), on=["g"], left_time="__n", right_time="at")
    both = below.select(bin_, F.col("there_asof").alias("lo")).join(up.select(bin_, F.col("there_asof").alias("hi")), bin_)
    nearer = F.col("hi").isNull() | (F.col(bin_) - F.col("lo") <= F.col("hi") - F.col(bin_))
    return both.select(bin_, F.when(F.col("lo").isNotNull() & nearer, F.col("lo")).otherwise(F.col("hi")).alias("bin"))


def labelled_union(parts: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows of several kinds under one another, with kind and label."""
    out = None
    for kind, (df, label) in parts.items():
        part = df.withColumns({"kind": F.lit(kind), "label": F.lit(label)})
        out = part if out is None else out.unionByName(part)
    return out


def paired(df: DataFrame, *, key: list[str], of: str, values: list) -> DataFrame:
    """key, missing: keys that lack one of the values, and how many they lack."""
    g = df.where(F.col(of).isin(values)).groupBy(*key).agg(F.count_distinct(of).alias("n"))
    every = df.select(*key).distinct().join(g, key, "left")
    return every.select(*key, (F.lit(len(values)) - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def mask(dt: Column, within: float) -> Column:
    """at_event for a time difference of zero, in_window up to ``within``, else outside; null is outside."""
    return F.when(dt == 0, "at_event").when(F.abs(dt) <= within, "in_window").otherwise("outside")
