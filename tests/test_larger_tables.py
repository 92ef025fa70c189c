"""Queries on rows that the small tables don't have: against their SQL, and against all pairs."""

import __spark_entry__ as entry
import duckdb
import pytest


def against_sql(spark, folder, name, **tables):
    """Rows of the query and of its SQL over the tables, given as SQL of DuckDB."""
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for t, rows in tables.items():
            con.execute(f"copy ({rows}) to '{folder}/{t}.parquet'")
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        got = entry.queries()[name](spark, str(folder))
        want = con.sql("select " + ", ".join(f'"{c}"' for c in got.columns) + f" from ({entry.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple((x is None, x) for x in row)
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert got == sorted(want, key=key)
    return got


def test_triggers_after_the_first_day_and_too_late_ones(spark, tmp_path):
    got = against_sql(spark, tmp_path, "survey_annual_triggers", supplier="select (r * 7)::bigint as s_suppkey from range(0, 400) t(r)")
    assert {r[0] for r in got if r[2] > 61496} and len({r[0] for r in got}) < 400


def test_ratios_at_the_threshold_count_as_measured(spark, tmp_path):
    """Every error with values whose ratio is 4.9 but for the last digits, and a step beside it."""
    rows = "select m - 1 + 90 * k as event_id, m % 7 as user_id, round(20 + 0.49 * m + k * 0.01, 2)::double as value from range(1, 91) a(m), range(-1, 2) b(k)"
    got = against_sql(spark, tmp_path, "opx_recounted", events=f"select * replace (event_id + 90 as event_id) from ({rows})")
    assert sum(r[2] for r in got) > 90


def test_next_event_of_another_user(spark, tmp_path):
    """Runs of one user over several half hours, equal times, windows that end on an event, null users and times."""
    minutes = "[0, 0, 0, 5, 5, 29, 30, 31, 35, 59, 60, 60, 61, 89, 90, 119, 120, 150, 151, 240, 300, 329, 330, 420, 449, 450, 451]"
    users = "[1, 1, 2, 1, 1, 1, 1, 3, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 1, 1, 1, 2, null, 1, 3, 3]"
    rows = f"select (i * 7 % 29)::bigint as event_id, ({users})[i] as user_id, timestamp '2024-01-01' + to_minutes(({minutes})[i]) as ts, 'view' as event_type, 1.0::double as value from range(1, 28) t(i)"
    got = against_sql(spark, tmp_path, "join_mismatch_fallback", events=f"{rows} union all select 100, 1, null, 'view', 1.0")
    assert len(got) == 28


def test_next_event_forms_no_pairs(spark, tmp_path):
    with duckdb.connect() as con:
        con.execute(f"copy (select i as event_id, i % 2 as user_id, timestamp '2024-01-01' + to_milliseconds(i) as ts from range(0, 4000) t(i)) to '{tmp_path}/events.parquet'")
    out = entry.queries()["join_mismatch_fallback"](spark, str(tmp_path))
    assert "__bucket" not in out._jdf.queryExecution().toString()  # the range join's key
    assert {tuple(r) for r in out.collect()} == {(i, i + 1) for i in range(3999)} | {(3999, -1)}


PART = "select i::bigint as p_partkey, 'B' || ({b}) as p_brand, 'T' || i % 3 as p_type, ({s})::int as p_size, ({p})::double as p_retailprice from range(0, {n}) t(i)"


def test_nearest_part_among_copies_and_lone_ones(spark, tmp_path):
    """Copies in numbers, parts alone in their brand, far ones, and neighbours at equal distance."""
    shapes = [("i % 5", "i % 7", "900 + i % 11", 700), ("5", "i * 1000", "i * i", 30), ("6 + i", "1", "900", 3), ("20", "i % 2 * 40", "900", 4)]
    rows = " union all ".join(f"select * replace (p_partkey + {1000 * k} as p_partkey) from ({PART.format(b=b, s=s, p=p, n=n)})" for k, (b, s, p, n) in enumerate(shapes))
    got = against_sql(spark, tmp_path, "join_nearest", part=rows)
    assert len(got) == 734 and max(r[2] for r in got) > 1000


def test_nearest_rows_meet_no_pairs_of_a_whole_group(spark, monkeypatch):
    """Fewer distances than a tenth of all pairs, and each block asks for itself."""
    import numpy as np
    from orrery.operators import nearest as N

    rng = np.random.default_rng(3)
    a, b = rng.random((3000, 3)), np.repeat(rng.random((1500, 3)), 2, 0)
    met, first = 0, {}
    for i, j in N.candidates(a, b, 1e-9):
        met += len(i)
        first |= {int(k): np.linalg.norm(a[k] - b[m]) for k, m in zip(i, j, strict=True)}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)
    assert len(first) == 3000 and np.allclose([first[k] for k in range(3000)], want) and met <= 2 * 3000 + 10
    monkeypatch.setattr(N, "ASKERS", 50)
    p = spark.createDataFrame([(k, 1, float(x)) for k, x in enumerate(rng.random(200))], "id long, g int, x double")
    r = spark.createDataFrame([(k, 1, float(x)) for k, x in enumerate(rng.random(90))], "key long, g int, x double")
    got = {r_.id: r_.key for r_ in N.nearest_rows(p, r, group="g", id_="id", key="key", at=["x"], score=lambda x, y: abs(x[:, 0] - y[:, 0]), slack=0.0).collect()}
    rows = r.collect()
    assert got == {q.id: min(rows, key=lambda c: (abs(c.x - q.x), c.key)).key for q in p.collect()}


def test_nearest_cells_and_levels(spark, tmp_path):
    """Points of maps of few cells and of many, poles and copies of cells included."""
    part = PART.format(b="1", s="i % 9 + 1", p="900 + i % 90", n=4000)
    against_sql(spark, tmp_path, "sky_nearest_cell", part=part, supplier="select i::bigint as s_suppkey from range(0, 900) t(i)")
    got = against_sql(spark, tmp_path, "sky_levels_at", part=part, customer="select i::bigint as c_custkey, (i % 25)::int as c_nationkey from range(0, 900) t(i)")
    assert len({r[0] for r in got}) == len(got) > 300


@pytest.mark.parametrize("name", ["sky_nearest_cell", "sky_levels_at"])
def test_cells_are_not_broadcast(spark, tmp_path, name):
    """Files are small for their rows, so a join of a map's points and cells, or levels, would be taken for a small one."""
    with duckdb.connect() as con:
        con.execute(f"copy ({PART.format(b='1', s='i % 9 + 1', p='900 + i % 90', n=500)}) to '{tmp_path}/part.parquet'")
        con.execute(f"copy (select i::bigint as s_suppkey from range(0, 50) t(i)) to '{tmp_path}/supplier.parquet'")
        con.execute(f"copy (select i::bigint as c_custkey, (i % 25)::int as c_nationkey from range(0, 50) t(i)) to '{tmp_path}/customer.parquet'")
    out = entry.queries()[name](spark, str(tmp_path))
    assert out.count() > 0 and "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


EMB = "select k::bigint as vec_id, {label} as label, list_transform(range(0, 12), lambda i: (((k % {m}) * 37 + i * 11 + (k % {m}) * i * 5) % 19 / 10.0)::float) as embedding from range(0, 1200) t(k)"


@pytest.mark.parametrize("name", ["emb_knn_distinct_parent", "ret_directions"])
def test_vectors_and_their_copies_in_several_blocks(spark, tmp_path, monkeypatch, name):
    """Equal distances and products in number, some vectors without a label; blocks of few rows."""
    from orrery.operators import vectors as V

    monkeypatch.setattr(V, "ROWS", 100)
    monkeypatch.setattr(V, "QUERIES", 4)
    against_sql(spark, tmp_path, name, embeddings=EMB.format(label="case when k % 50 <> 7 then (k % 9)::int end", m=130))


@pytest.mark.parametrize("name", ["emb_knn_distinct_parent", "opx_neighbour_audit", "ret_directions"])
def test_vectors_meet_as_matrices(spark, tmp_path, name):
    with duckdb.connect() as con:
        con.execute(f"copy ({EMB.format(label='(k % 9)::int', m=1300)}) to '{tmp_path}/embeddings.parquet'")
    out = entry.queries()[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "aggregate(filter(zip_with" not in plan
    assert out.count() > 0


def test_caliper_pairs_of_copies(spark, tmp_path):
    """Copies go as one kind through the range join and come back as their pairs."""
    got = against_sql(spark, tmp_path, "join_caliper", part=PART.format(b="1", s="i % 12", p="900 + i % 40 * 3", n=400) + " union all select 1000 + p_partkey, p_brand, p_type, p_size, p_retailprice from (" + PART.format(b="1", s="i % 12", p="900 + i % 40 * 3", n=400) + ")")
    assert any(r[2] == 0 and r[3] == 0 for r in got)
    plan = entry.queries()["join_caliper"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "collect_list" in plan


def test_dense_windows_are_dealt_to_tasks(spark, tmp_path):
    """Each event within six hours, ends included, of others' only; a small table does not go to one task for its few bytes."""
    rows = "select i::bigint as event_id, case when i % 31 <> 0 then i % 7 end as user_id, timestamp '2024-01-01' + to_minutes((i * 11 % 300 * 30)::int) as ts, 'view' as event_type, case when i % 17 <> 0 then (i % 90)::double end as value from range(0, 600) t(i)"
    got = against_sql(spark, tmp_path, "join_interval_after", events=f"{rows} union all select 1000, 1, null, 'view', 1.0")
    assert {0, 6 * 3_600_000_000} <= {r[2] for r in got}
    out = entry.queries()["join_interval_after"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1 and "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_dense_windows_shuffle_each_anchor_once(spark, tmp_path):
    """What lies on disk is each event once and the few candidates once a bucket."""
    rows = "select i::bigint as event_id, i % 7 as user_id, timestamp '2024-01-01' + to_minutes((i * 11 % 300 * 30)::int) as ts, 'view' as event_type, case when i % 6 = 0 then 1.0 else 90.0 end as value from range(0, 600) t(i)"
    sc = spark.sparkContext
    sc.setJobGroup("windows", "")
    try:
        got = against_sql(spark, tmp_path, "join_interval_after", events=rows)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r[1] % 6 for r in got} == {0}
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty(30_000)
    stages = {k for job in sc.statusTracker().getJobIdsForGroup("windows") for k in sc.statusTracker().getJobInfo(job).stageIds}
    assert 600 < sum(scala.statusStore().lastStageAttempt(k).shuffleWriteRecords() for k in stages) <= 600 + 3 * 100


def test_least_cost_pairs_on_a_line_form_no_edges(spark, tmp_path, monkeypatch):
    """As many pairs and the same sum as over all edges: copies, ends of the caliper, a price that is not whole, one that is none."""
    import numpy as np
    from orrery.operators import posterior as P
    from orrery.plans.tables import load
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "STEPS", 7, raising=False)
    price = "case when i = 5 then null when i = 6 then 'nan'::double when i % 5 = 1 and i % 3 = 0 then 900 + i / 7.0 else 900 + i * 37 % 90 * 4.1 end"
    with duckdb.connect() as con:
        con.execute(f"copy ({PART.format(b='i % 5', s='i * 13 % 50 + 1', p=price, n=600)}) to '{tmp_path}/part.parquet'")
    out = entry.queries()["srt_least_cost_pairs"](spark, str(tmp_path))
    assert "__bucket" not in out._jdf.queryExecution().toString()  # the range join's key
    p = load(spark, str(tmp_path), "part").where("p_retailprice < 1e9")
    a, b = (p.where(w).select("p_brand", F.col("p_partkey").alias(k), F.col("p_retailprice").alias(x)) for w, k, x in (("p_size <= 25", "i", "x"), ("p_size > 25", "j", "y")))
    edges = a.join(b, "p_brand").where("y between x - 60 and x + 60").select("p_brand", "i", "j", F.round(F.abs(F.col("x") - F.col("y")), 4).alias("cost"))
    got, want, every = (df.toPandas() for df in (out, P.matched(edges, by=["p_brand"], most=10_000), edges))
    assert len(got) == len(want) > 100 and np.isclose(got.cost.sum(), want.cost.sum())
    assert not got.duplicated("i").any() and not got.duplicated("j").any()
    assert len(got.merge(every, on=["p_brand", "i", "j", "cost"])) == len(got)


def test_least_cost_pairs_are_all_there(spark, tmp_path):
    """A brand of 10,100 pairs, none of which is left out for the number of its pairs."""
    with duckdb.connect() as con:
        con.execute(f"copy ({PART.format(b='1', s='i % 2 * 49 + 1', p='900 + i // 2 * 50', n=20200)}) to '{tmp_path}/part.parquet'")
    got = entry.queries()["srt_least_cost_pairs"](spark, str(tmp_path)).collect()
    assert {(r.i, r.j, r.cost) for r in got} == {(k, k + 1, 0.0) for k in range(0, 20200, 2)} and len(got) == 10100


@pytest.mark.parametrize("steps", [1, 3, 512])
def test_line_pairs_are_the_least_of_all(monkeypatch, steps):
    import numpy as np
    import pandas as pd
    from orrery.operators import posterior as P

    monkeypatch.setattr(P, "STEPS", steps)
    rng = np.random.default_rng(steps)
    for _ in range(60):
        (n, m), w, most = rng.integers(1, 9, 2), int(rng.integers(0, 12)), int(rng.integers(3, 40))
        x, y = np.sort(rng.integers(0, most, n)), np.sort(rng.integers(0, most, m))
        x = x[[bool((abs(y - v) <= w).any()) for v in x]]
        if len(x):
            p, q = P.line_pairs(x, y, np.searchsorted(y, x - w), np.searchsorted(y, x + w, "right"))
            e = pd.DataFrame([(a, b, float(abs(x[a] - y[b]))) for a in range(len(x)) for b in range(m) if abs(x[a] - y[b]) <= w], columns=["i", "j", "cost"])
            best = P.cheapest_matching(e, 100)
            assert len(p) == len(best) and abs(x[p] - y[q]).sum() == best.cost.sum() and len({*p}) == len({*q}) == len(p) and (abs(x[p] - y[q]) <= w).all()


def greedy_by_hand(edges, most):
    used, taken = set(), []
    for cost, i, j in sorted((c, i, j) for i, j, c in edges):
        if len(taken) < most and not {i, j} & used:
            used |= {i, j}
            taken.append((i, j, cost))
    return sorted(taken)


@pytest.mark.parametrize("most", [1, 2, 5])
def test_greedy_choice_of_many_edges_in_few(spark, most):
    """Stars whose ends are used early, edges twice, equal costs: the first of each end are enough."""
    import random

    from orrery.operators import posterior as P

    rng = random.Random(most)
    edges = [(i, j, float(c)) for i in range(4) for j in range(4, 60) for c in {rng.randrange(3), rng.randrange(3)}]
    edges += [(i, j, 1.0 + rng.randrange(9)) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.3]
    df = spark.createDataFrame([("g", *e) for e in edges], "g string, i int, j int, cost double")
    out = P.greedy_disjoint(df, by=["g"], most=most)
    assert sorted((r.i, r.j, r.cost) for r in out.collect()) == greedy_by_hand(edges, most)
    assert "row_number" in out._jdf.queryExecution().toString()  # a task gets few of the edges


def test_greedy_pairs_of_copies(spark, tmp_path):
    """As over all pairs, with more copies of a part than can be used, and parts that have one or none."""
    shapes = [("i % 3", "900 + i % 4 * 3", 90), ("3 + i", "950 + i * 1.7", 40), ("20 + i % 2", "990 + i % 9", 60)]
    rows = " union all ".join(f"select * replace ((p_partkey * 7 % 101 * 10 + {k})::bigint as p_partkey) from ({PART.format(b='1', s=s, p=p, n=n)})" for k, (s, p, n) in enumerate(shapes))
    with duckdb.connect() as con:
        con.execute(f"copy ({rows}) to '{tmp_path}/part.parquet'")
    out = entry.queries()["srt_greedy_disjoint"](spark, str(tmp_path))
    parts = spark.read.parquet(f"{tmp_path}/part.parquet").collect()
    want = []
    for t in {p.p_type for p in parts}:
        own = [p for p in parts if p.p_type == t]
        near = [(a.p_partkey, b.p_partkey, round(abs(a.p_retailprice - b.p_retailprice), 4)) for a in own for b in own if a.p_partkey < b.p_partkey and abs(a.p_size - b.p_size) <= 1 and abs(a.p_retailprice - b.p_retailprice) < 5]
        want += [(t, *e) for e in greedy_by_hand(near, 5)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) == 15


def test_nearer_half_of_caliper_pairs_of_copies(spark, tmp_path):
    """The quantile counts the pairs of copies; calipers' ends to the last digit, a key that occurs twice, and parts without size."""
    one = PART.format(b="1", s="case when i % 61 <> 0 then i * 5 % 17 end", p="900 + i * 7 % 90 + i % 10 / 10.0", n=300)
    rows = f"{one} union all select 500 - p_partkey, p_brand, p_type, p_size, p_retailprice from ({one}) where p_partkey % 4 < 3 union all select p_partkey, p_brand, p_type, p_size, p_retailprice from ({one}) where p_partkey % 50 = 1"
    got = against_sql(spark, tmp_path, "join_caliper_quantile", part=rows)
    assert any(r[3] == 0 for r in got) and len(set(got)) < len(got)
    plan = entry.queries()["join_caliper_quantile"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "collect_list" in plan
