import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import core as C
from orrery.operators import catalog as K
from orrery.operators import intervals as I
from orrery.operators import metrics as M
from orrery.operators import sampling as S
from orrery.operators import sky as Y

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1)), min_size=2, max_size=40))
def test_auroc_is_the_pair_probability(spark, rows):
    got = M.auroc(spark.createDataFrame([(1, s / 4, y) for s, y in rows], "g int, score double, label int"), by=["g"]).first().auroc
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    if not pos or not neg:
        assert got is None
    else:
        assert got == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_ties_share_the_expected_rank(spark):
    df = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (1, 0.5, False), (1, 0.9, False), (2, None, True), (2, 0.1, False)], "g int, score double, is_positive boolean")
    got = {r.g: r for r in M.expected_rank(df, by=["g"]).select("*", M.expected_recall(2).alias("r2"), M.expected_reciprocal_rank().alias("rr")).collect()}
    assert (got[1].above, got[1].tied, got[1].r2) == (1, 2, pytest.approx(1 / 3))
    assert got[1].rr == pytest.approx((1 / 2 + 1 / 3 + 1 / 4) / 3)
    assert (got[2].above, got[2].tied) == (1, 0)


def test_holm_runs_upward(spark):
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate((0.01, 0.04, 0.03, 0.03))], "f int, k int, p double")
    assert [pytest.approx(x) for x in (0.04, 0.09, 0.09, 0.09)] == [r.p_holm for r in M.holm(df, by=["f"], order=["k"]).orderBy("p", "k").collect()]


@FEW
@given(st.lists(st.integers(0, 200), min_size=1, max_size=30), st.lists(st.integers(0, 200), min_size=1, max_size=30), st.integers(0, 40), st.integers(1, 50))
def test_interval_join_meets_each_pair_once(spark, starts, points, length, width):
    a = spark.createDataFrame(list(enumerate(starts)), "i int, s long")
    b = spark.createDataFrame(list(enumerate(points)), "j int, t long")
    got = sorted(tuple(r) for r in I.interval_join(a, b, lo=F.col("s"), hi=F.col("s") + length, at=F.col("t"), width=width).select("i", "j").collect())
    assert got == sorted((i, j) for i, s in enumerate(starts) for j, t in enumerate(points) if s <= t <= s + length)
    free = {r.j for r in I.interval_join(a, b, lo=F.col("s"), hi=F.col("s") + length, at=F.col("t"), width=width, how="left_anti").collect()}
    assert free == {j for j, t in enumerate(points) if not any(s <= t <= s + length for s in starts)}


def test_credible_levels_share_ties(spark):
    cells = spark.createDataFrame([(1, 0, 1.0, 0.9), (1, 1, 0.0, 0.1), (2, 0, 1.0, 0.25), (2, 1, 1.0, 0.25), (2, 2, 1.0, 0.5)], "map_id int, cell_id int, area double, prob double")
    got = {(r.map_id, r.cell_id): round(r.level, 6) for r in Y.credible_levels(cells).collect()}
    assert got == {(1, 0): 0.9, (1, 1): 1.0, (2, 0): 1.0, (2, 1): 1.0, (2, 2): 0.5}
    assert {r.map_id: r.area for r in Y.credible_area(cells, 0.1).collect()} == {1: 1.0, 2: 1.0}


def test_quota_adds_up(spark):
    bins = spark.createDataFrame([(k, n) for k, n in enumerate((5, 1, 3, 1))], "b int, n long")
    got = {r.b: r.quota for r in S.largest_remainder(bins, 7, bin_="b", count="n").collect()}
    assert sum(got.values()) == 7 and all(got[k] <= n for k, n in enumerate((5, 1, 3, 1)))


def test_split_keeps_one_on_each_side(spark):
    df = spark.createDataFrame([(g, k) for g, n in ((1, 1), (2, 2), (3, 50)) for k in range(n)], "g int, k int")
    got = S.stratified_split(df, 0.1, by=["g"], key=["g", "k"], seed="s").groupBy("g").pivot("part", ["train", "val"]).count().fillna(0)
    assert {tuple(r) for r in got.collect()} == {(1, 1, 0), (2, 1, 1), (3, 45, 5)}


def test_galleries_are_nested(spark):
    df = spark.createDataFrame([(1, k) for k in range(9)], "g int, k int")
    rows = S.prefix_galleries(df, [2, 4, 20], by=["g"], order=["k"]).collect()
    sets = {n: {r.k for r in rows if r["size"] == n} for n in (2, 4, 20)}
    assert sets[2] == {0} and sets[4] == {0, 1, 2} and sets[20] == set(range(9))


def test_booleans_and_contracts(spark):
    df = spark.createDataFrame([(" TRUE",), ("0",), (None,)], "x string")
    assert [r[0] for r in df.select(K.parse_bool(F.col("x"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "x string").select(K.parse_bool(F.col("x"))).collect()
    with pytest.raises(ValueError, match="contract broken"):
        K.require(df.withColumn("k", F.lit(1)), {"present": F.col("x").isNotNull()}, "k")


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 1.0, 1.1, None)], "x double")
    assert [r[0] for r in df.select(C.in_bins(F.col("x"), [0.0, 0.5, 1.0])).collect()] == [None, 0, 1, 1, None, None]
    assert [r[0] for r in df.select(C.in_bins(F.col("x"), [0.0, 0.5, 1.0], last_closed=False)).collect()] == [None, 0, 1, None, None, None]


def test_leap_seconds(spark):
    df = spark.createDataFrame([(1187008882.4,), (0.0,)], "g double")
    assert [round(r[0], 6) for r in df.select(C.gps_to_mjd(F.col("g"))).collect()] == [57982.528523, 44244.0]


@FEW
@given(st.lists(st.lists(st.integers(0, 20), min_size=4, max_size=4), min_size=1, max_size=4))
def test_least_cost_pairs(rows):
    from itertools import permutations

    from orrery.operators import posterior as P

    costs = np.array(rows, float)
    got = P.least_cost_pairs(costs)
    assert [r for r, _ in got] == list(range(len(rows))) and len({c for _, c in got}) == len(rows)
    assert sum(costs[r, c] for r, c in got) == min(sum(costs[r, c] for r, c in enumerate(p)) for p in permutations(range(4), len(rows)))


def test_matched_pairs_are_the_cheapest(spark):
    from itertools import permutations

    from orrery.operators import posterior as P

    rows = [(1, i, j, float((i * 7 + j * 5) % 11)) for i in range(4) for j in range(5) if (i + j) % 4]
    got = P.matched(spark.createDataFrame(rows, "g int, i int, j int, cost double"), by=["g"], most=10).collect()
    cost = {(i, j): c for _, i, j, c in rows}
    every = [[(i, j) for i, j in enumerate(p) if (i, j) in cost] for p in permutations(range(5), 4)]
    most = max(map(len, every))
    assert len(got) == most and len({r.i for r in got}) == len({r.j for r in got}) == most
    assert sum(r.cost for r in got) == min(sum(cost[e] for e in x) for x in every if len(x) == most)
    assert len(P.matched(spark.createDataFrame(rows, "g int, i int, j int, cost double"), by=["g"], most=2).collect()) == 2


def test_shortcut_finds_what_gives_the_label_away(spark):
    df = spark.range(400).selectExpr("cast(id % 20 as double) as a", "cast(id * 7 % 13 as double) as b", "cast(id % 20 > 9 as int) as y").unionByName(spark.createDataFrame([(float("nan"), 1.0, 1)], "a double, b double, y int"))
    assert M.shortcut_auc(df, ["a", "b"], "y").first().auroc > 0.99 and M.shortcut_auc(df, ["b"], "y").first().auroc < 0.7
