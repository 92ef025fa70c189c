"""Light-curve operators over long observation tables.

Rows are (object, band, t_us, flux, error): time in microseconds since MJD 0.
Observations whose flux or error is null or not finite are left out, as are
errors that are not positive, before any comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C

GAP_US = 2 * 3600 * 1_000_000
DETECTION_SNR = 5.0


def usable(obs: DataFrame) -> DataFrame:
    return obs.where(C.finite(F.col("flux")) & C.finite(F.col("error")) & (F.col("error") > 0))


def with_clusters(obs: DataFrame, *, gap_us: int = GAP_US, by: tuple[str, ...] = ("object", "band")) -> DataFrame:
    """Adds ``cluster``: a new one begins where the gap to the previous observation exceeds ``gap_us``."""
    order = Window.partitionBy(*by).orderBy("t_us")
    begins = (F.col("t_us") - F.lag("t_us").over(order) > gap_us).cast("int")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return obs.withColumn("__begins", F.coalesce(begins, F.lit(0))).withColumn("cluster", F.sum("__begins").over(running).cast("int")).drop("__begins")


def merge(obs: DataFrame, *, gap_us: int = GAP_US) -> DataFrame:
    """One row for each (object, band, cluster): inverse-variance weighted flux and time, combined error."""
    w = F.lit(1.0) / (F.col("error") * F.col("error"))
    weighed = with_clusters(usable(obs), gap_us=gap_us).withColumn("w", w)
    # Times are weighed relative to the cluster's first, which keeps their microseconds.
    first = F.min("t_us").over(Window.partitionBy("object", "band", "cluster"))
    weighed = weighed.withColumn("t0", first)
    return weighed.groupBy("object", "band", "cluster").agg(
        (F.min("t0") + F.sum(F.col("w") * (F.col("t_us") - F.col("t0"))) / F.sum("w")).alias("t_us"),
        (F.sum(F.col("w") * F.col("flux")) / F.sum("w")).alias("flux"),
        (F.lit(1.0) / F.sqrt(F.sum("w"))).alias("error"),
        F.count("*").alias("merged"),
    )


def first_detection(obs: DataFrame, *, fallback: Column | None = None, flag: Column | None = None, threshold: float = DETECTION_SNR) -> DataFrame:
    """first_us of each object: the first row (by seq) of SNR over the threshold, else the first whose flag has a
    detection bit (1024 or 4096), else a header value that isn't a sentinel (<= 0 or >= 900000 days)."""
    snr = C.snr(F.col("flux"), F.col("error"))
    aggs = [F.min_by("t_us", F.when(snr > threshold, F.col("seq"))).alias("by_snr")]
    aggs.append((F.min_by("t_us", F.when(flag.bitwiseAND(5120) != 0, F.col("seq"))) if flag is not None else F.lit(None).cast("long")).alias("by_flag"))
    head = F.max(F.when((fallback > 0) & (fallback < 900000), fallback * F.lit(8.64e10))).cast("long") if fallback is not None else F.lit(None).cast("long")
    return obs.groupBy("object").agg(*aggs, head.alias("by_head")).select("object", F.coalesce("by_snr", "by_flag", "by_head").alias("first_us"))


def meta(obs: DataFrame, *, threshold: float = DETECTION_SNR) -> DataFrame:
    """Numbers of observations, detections and bands, time span in days, and the band if there is but one."""
    snr = C.snr(F.col("flux"), F.col("error"))
    return obs.groupBy("object").agg(
        F.count("*").alias("n_obs"),
        F.count_if(F.coalesce(snr > threshold, F.lit(False))).alias("n_det"),
        F.count_distinct("band").alias("n_bands"),
        ((F.max("t_us") - F.min("t_us")) / F.lit(8.64e10)).alias("t_span"),
        F.when(F.count_distinct("band") == 1, F.min("band")).alias("single_band"),
    )


def crop(obs: DataFrame, zero: DataFrame, *, before_days: float, after_days: float) -> DataFrame:
    """Observations within [zero - before, zero + after] of their object's zero time (object, zero_us)."""
    day = 8.64e10
    return obs.join(zero, "object").where((F.col("t_us") >= F.col("zero_us") - F.lit(before_days * day)) & (F.col("t_us") <= F.col("zero_us") + F.lit(after_days * day)))


def prefix(obs: DataFrame, k: int, *, threshold: float = DETECTION_SNR) -> DataFrame:
    """Observations up to the time of the k-th detection; all if there are fewer."""
    detected = F.coalesce(C.snr(F.col("flux"), F.col("error")) > threshold, F.lit(False))
    order = Window.partitionBy("object").orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = obs.withColumn("n_det", F.sum(detected.cast("int")).over(order))
    cut = F.min(F.when(F.col("n_det") >= k, F.col("t_us"))).over(Window.partitionBy("object"))
    return counted.withColumn("cut_us", cut).where(F.col("cut_us").isNull() | (F.col("t_us") <= F.col("cut_us")))


def prefix_manifest(obs: DataFrame, support: list[int], *, threshold: float = DETECTION_SNR) -> DataFrame:
    """A row for each object and feasible k of the support, and one for all of its detections."""
    n = F.count_if(F.coalesce(C.snr(F.col("flux"), F.col("error")) > threshold, F.lit(False)))
    counted = obs.groupBy("object").agg(n.cast("int").alias("n_det")).where("n_det > 0")
    ks = F.array_union(F.filter(F.array(*[F.lit(k) for k in support]), lambda k: k <= F.col("n_det")), F.array("n_det"))
    return counted.select("object", "n_det", F.explode(ks).alias("k"))


def truncate(obs: DataFrame, most: int) -> DataFrame:
    """The ``most`` observations nearest the zero time of their object (column rel_us), by |rel_us| and seq."""
    order = Window.partitionBy("object").orderBy(F.abs("rel_us"), "seq")
    return obs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


def densify(obs: DataFrame, bands: list[str]) -> DataFrame:
    """One row for each object and time: a column of flux for each band (null: not observed), and the slot's number."""
    wide = obs.groupBy("object", "t_us").pivot("band", bands).agg(F.max("flux"))
    return wide.withColumn("slot", F.row_number().over(Window.partitionBy("object").orderBy("t_us")) - 1)


def undensify(wide: DataFrame, bands: list[str]) -> DataFrame:
    """The long form of ``densify``: a row for each value that is there."""
    return wide.unpivot(["object", "t_us", "slot"], bands, "band", "flux").where("flux is not null")
