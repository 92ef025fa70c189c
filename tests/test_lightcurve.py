import math

import pytest

from orrery.functions import core as C
from orrery.operators import lightcurve as L
from pyspark.sql import functions as F

HOUR = 3_600_000_000
OBS = "object long, band string, t_us long, flux double, error double, seq long"


def test_gap_is_closed_at_two_hours(spark):
    rows = [(1, "r", 0, 1.0, 1.0, 0), (1, "r", 2 * HOUR, 3.0, 1.0, 1), (1, "r", 4 * HOUR + 1, 5.0, 1.0, 2), (1, "g", 0, 1.0, 1.0, 3)]
    got = {r.seq: r.cluster for r in L.with_clusters(spark.createDataFrame(rows, OBS)).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0}


def test_merge_weighs_by_inverse_variance(spark):
    rows = [(1, "r", 0, 1.0, 1.0, 0), (1, "r", HOUR, 4.0, 2.0, 1), (1, "r", HOUR, float("nan"), 1.0, 2), (1, "r", HOUR, 9.0, 0.0, 3), (1, "r", HOUR, None, 1.0, 4)]
    (r,) = L.merge(spark.createDataFrame(rows, OBS)).collect()
    assert (r.flux, r.error, r.merged) == (pytest.approx(1.6), pytest.approx(1 / math.sqrt(1.25)), 2)
    assert r.t_us == pytest.approx(0.2 * HOUR)


def test_first_detection_priority(spark):
    rows = [(1, "r", 5, 50.0, 1.0, 0, 0), (1, "r", 1, 5.0, 1.0, 1, 4096), (2, "r", 7, 5.0, 1.0, 0, 1), (2, "r", 9, 1.0, 1.0, 1, 1024), (3, "r", 3, 1.0, 1.0, 0, 0), (4, "r", 3, 1.0, 1.0, 0, 0)]
    df = spark.createDataFrame(rows, OBS + ", flag int").withColumn("head", F.when(F.col("object") == 3, 2.0).otherwise(1e6))
    got = {r.object: r.first_us for r in L.first_detection(df, flag=F.col("flag"), fallback=F.col("head")).collect()}
    assert got == {1: 5, 2: 9, 3: 2 * 86_400_000_000, 4: None}


def test_prefix_keeps_all_without_k_detections(spark):
    rows = [(1, "r", t, f, 1.0, t) for t, f in ((1, 9.0), (2, 1.0), (3, 9.0), (4, 9.0))] + [(2, "r", 1, 1.0, 1.0, 1)]
    got = sorted((r.object, r.seq) for r in L.prefix(spark.createDataFrame(rows, OBS), 2).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_luptitude_round_trip(spark):
    rows = [(x,) for x in (-1e12, -50.0, 0.0, 3.5, 1e9)]
    b = C.softening(F.lit(24.7))
    for r in spark.createDataFrame(rows, "f double").select("f", C.luptitude_to_flux(C.luptitude(F.col("f"), b), b).alias("g")).collect():
        assert r.g == pytest.approx(r.f, rel=1e-9, abs=1e-6)


def test_edges(spark):
    empty = spark.createDataFrame([], OBS)
    assert L.merge(empty).count() == L.meta(empty).count() == L.prefix(empty, 1).count() == 0
    one = L.meta(spark.createDataFrame([(1, "r", 5, None, None, 0)], OBS)).first()
    assert (one.n_obs, one.n_det, one.n_bands, one.single_band) == (1, 0, 1, "r")
    bands = spark.createDataFrame([("LSST-r", 2), ("y", 5), ("Y", 5), ("u", 0), ("x", None), (None, None)], "b string, i int")
    assert all(r.i == r.j for r in bands.select("i", C.band_index(F.col("b")).alias("j")).collect())
