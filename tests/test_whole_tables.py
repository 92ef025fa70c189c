"""Queries hold their whole tables: against the registered SQL, and by what they must hold."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orrery import registry
from orrery.operators import intervals as I
from orrery.operators import ranking as R
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def whole(name):
    sql = registry.oracle_sql()[name]
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for t in ("customer", "orders", "lineitem", "events", "embeddings"):
            con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
        return con.sql(sql).fetchall()


def same(spark, name):
    got = [tuple(r) for r in registry.queries()[name](spark, SMALL).collect()]
    want = whole(name)
    key = lambda row: tuple(x if isinstance(x, (int, str)) else round(x, 2) for x in row)
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(x == y or x == pytest.approx(y, rel=1e-9, abs=1.1e-4) for x, y in zip(a, b, strict=True)), (a, b)
    return got


def test_statistics_and_windows_take_every_key(spark):
    same(spark, "stat_bootstrap")
    bins = same(spark, "agg_dose_response")
    assert sum(r[1] for r in bins) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    ranks = same(spark, "win_dense_remap")
    assert len(ranks) == spark.read.parquet(f"{SMALL}/orders.parquet").count()


@pytest.mark.parametrize("rows", [1, 3, 5, 13])
def test_positions_equal_one_global_window(spark, rows):
    df = spark.createDataFrame([(k, None if k == 2 else k * 37 % 11) for k in range(rows)], "k int, v int").repartition(3)
    got = R.positions(df, bucket=F.floor(F.col("v") / 4), order=["v", "k"]).withColumn("bin", R.ntile(5, F.col("position"), F.col("total")))
    df.createOrReplaceTempView("positions_rows")
    want = spark.sql("select k, row_number() over (order by v, k) - 1 as p, ntile(5) over (order by v, k) as b, dense_rank() over (order by v) - 1 as r from positions_rows")
    assert {(r.k, r.position, r.bin) for r in got.collect()} == {(r.k, r.p, r.b) for r in want.collect()}
    dense = R.positions(df, bucket=F.floor(F.col("v") / 4), order=["v"], dense=True)
    assert {(r.k, r.position) for r in dense.collect()} == {(r.k, r.r) for r in want.collect()}


def test_many_to_many_counts_every_pair(spark):
    got = same(spark, "join_many_to_many")
    lines, orders = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "orders"))
    assert sum(r[1] for r in got) == lines.join(orders, F.expr("l_suppkey % 50 = o_custkey % 50")).count()


@pytest.mark.parametrize("name", ["join_interval_after", "join_interval_before", "join_mismatch_fallback", "join_two_centres", "join_rings", "join_busy_anti"])
def test_every_event_is_an_anchor(spark, name):
    same(spark, name)


@FEW
@given(st.lists(st.integers(-40, 40), min_size=1, max_size=25), st.lists(st.integers(-40, 40), max_size=25), st.integers(1, 50), st.integers(-20, 20))
def test_windows_count_without_pairs(spark, starts, points, width, shift):
    a = spark.createDataFrame(list(enumerate(starts)), "i int, s long")
    b = spark.createDataFrame(list(enumerate(points)), "j int, t long")
    got = {tuple(r) for r in I.in_windows(a, b, key="i", lo=F.col("s") + shift, at=F.col("t"), width=width, value="j").collect()}
    inside = lambda s: [j for j, t in enumerate(points) if s + shift <= t <= s + shift + width]
    assert got == {(i, len(inside(s)), min(inside(s), default=None)) for i, s in enumerate(starts)}


@pytest.mark.parametrize("name", ["emb_knn_distinct_parent", "ret_embedding_metrics"])
def test_every_twentieth_vector_is_a_query(spark, name):
    got = same(spark, name)
    ids = {r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    assert {r[0] for r in got} <= ids and any(r[0] % 40 and r[0] % 25 for r in got)


def test_every_band_comes_back(spark):
    got = same(spark, "lc_dense_roundtrip")
    assert {r[2] for r in got} == {r[0] for r in spark.read.parquet(f"{SMALL}/events.parquet").select("event_type").distinct().collect()}
