"""Join, sky, sampling and aggregate queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C
from ..operators import intervals as I
from ..operators import sampling as S
from ..operators import sky as Y
from ..operators import vectors as V
from ..operators.nearest import half_away, nearest_rows
from .tables import OBS_SQL, PARENT_SQL, load, observations, parents

HOUR = 3_600_000_000


def fk(spark, d):
    obs, p = observations(spark, d), parents(spark, d)
    return obs.join(p, "object").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("flux"), 5).alias("mean"))


def left_checked(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def validated_mn(spark, d):
    """Visits of each tile, samples by observations: each side is counted by tile first, no pairs are formed."""
    li, o = load(spark, d, "lineitem"), load(spark, d, "orders")
    tiles = o.groupBy((F.col("o_custkey") % 50).alias("tile")).agg(F.count("*").alias("n_tiles"))
    samples = li.groupBy((F.col("l_suppkey") % 50).alias("tile")).agg(F.count("*").alias("n_samples"))
    return samples.join(tiles, "tile").select("tile", (F.col("n_samples") * F.col("n_tiles")).alias("visits"))


def window_after(spark, d):
    """Candidates within [t, t + 6 h] of each event, another user's, largest value bound."""
    e = load(spark, d, "events").select("event_id", "user_id", "value", C.micros(F.col("ts")).alias("t"))
    anchors = e.select(F.col("event_id").alias("anchor"), F.col("user_id").alias("au"), F.col("t").alias("at"))
    candidates = e.where("value <= 60").drop("value")  # the fewer rows, so these are repeated for their buckets
    j = I.interval_join(candidates, anchors, lo=F.col("t") - 6 * HOUR, hi=F.col("t"), at=F.col("at"), width=3 * HOUR, dense=True)
    return j.where("user_id <> au").select("anchor", "event_id", (F.col("t") - F.col("at")).alias("dt"))


def times(spark, d):
    """Every event, as row and as anchor."""
    e = load(spark, d, "events").select("event_id", C.micros(F.col("ts")).alias("t"))
    return e, e.select(F.col("event_id").alias("anchor"), F.col("t").alias("at"))


def window_before(spark, d):
    e, anchors = times(spark, d)
    n = I.in_windows(anchors, e, key="anchor", lo=F.col("at") - 3 * HOUR, at=F.col("t"), width=3 * HOUR, value="event_id")
    return n.select("anchor", (F.col("n") - 1).alias("n")).where("n > 0")  # the anchor lies in its own window


def mismatch(spark, d):
    """The next event of another user within half an hour, else the fallback candidate -1."""
    e = load(spark, d, "events").select("event_id", "user_id", C.micros(F.col("ts")).alias("t"))
    n = I.next_other(e, key="event_id", group="user_id", time="t", within=HOUR // 2)
    return n.select(F.col("event_id").alias("anchor"), F.coalesce("pick", F.lit(-1)).alias("pick"))


def two_centres(spark, d):
    e, anchors = times(spark, d)
    sides = [I.in_windows(anchors, e, key="anchor", lo=F.col("at") + s * 12 * HOUR - HOUR, at=F.col("t"), width=2 * HOUR, value="event_id") for s in (-1, 1)]
    return sides[0].unionByName(sides[1]).groupBy("anchor").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where("n > 0")


def rings(spark, d):
    """Rows of each ring: those within its outer width less those within the width before; the anchor is in none."""
    e, anchors = times(spark, d)
    within = None
    for k, h in enumerate((1, 2, 4, 8)):
        n = I.in_windows(anchors, e, key="anchor", lo=F.col("at") - h * HOUR, at=F.col("t"), width=2 * h * HOUR, value="event_id")
        n = n.select("anchor", F.lit(k).alias("ring"), (F.col("n") - 1).alias("upto"))
        within = n if within is None else within.unionByName(n)
    inner = F.coalesce(F.lag("upto").over(Window.partitionBy("anchor").orderBy("ring")), F.lit(0))
    return within.withColumn("n", F.col("upto") - inner).where("n > 0").select("anchor", "ring", "n")


def busy_anti(spark, d):
    """Rows inside no busy interval; every error event opens one, as the observatory's down time."""
    e = load(spark, d, "events").select("event_id", "event_type", C.micros(F.col("ts")).alias("t"))
    busy = e.where("event_type = 'error'").select(F.col("t").alias("b"))
    return I.interval_join(busy, e, lo=F.col("b"), hi=F.col("b") + 2 * HOUR, at=F.col("t"), width=2 * HOUR, how="left_anti").select("event_id")


def as_of(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value", C.micros(F.col("ts")).alias("t"))
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    v = e.where("event_type = 'view'").select("user_id", F.col("t").alias("vt"), F.col("value"))
    return I.nearest_before(a, v, on=["user_id"], left_time="t", right_time="vt").select("event_id", F.round("value_asof", 6).alias("value"), F.coalesce("vt_asof", F.lit(-1)).alias("vt"))


def nearest(spark, d):
    """Nearest other part of its brand by scaled distance, for every part."""
    p = load(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100.0).alias("b"))
    dist = lambda x, y: half_away(np.sqrt((y[:, 0] - x[:, 0]) ** 2 + (y[:, 1] - x[:, 1]) ** 2), 9)
    near = nearest_rows(p.withColumnRenamed("p_partkey", "q"), p, group="p_brand", id_="q", key="p_partkey", at=["a", "b"], score=dist, slack=2e-9, other=True)
    return near.select("q", "p_partkey", F.round("score", 6).alias("distance"))


def division(spark, d):
    li = load(spark, d, "lineitem").select("l_partkey", F.concat_ws("", "l_returnflag", "l_linestatus").alias("scenario"))
    return I.division(li, item="l_partkey", of="scenario")


def caliper(spark, d):
    """Pairs i < j of equal type with both attributes within their calipers."""
    distance = {"dsize": F.col("dstep"), "dprice": F.round(F.abs(F.col("a") - F.col("b")), 4)}
    return I.caliper_pairs(load(spark, d, "part"), key="p_partkey", on=["p_type"], step="p_size", steps=3, at="p_retailprice", width=20, distance=distance).select("i", "j", "dsize", "dprice")


def knn_parents(spark, d):
    """Three nearest vectors of different label for each query, one for each label; some components count as missing."""
    e = load(spark, d, "embeddings")
    e = e.select("vec_id", "label", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 7 != 0, x.cast("double"))).alias("v"))
    pairs = V.nearest_by_parent(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q"), e, query="q", row="vec_id", parent="label", vector="v")
    nearest_ = V.unique_parents(pairs, 3, query="q", parent="label", row="vec_id", distance="d")
    return nearest_.select("q", "rank", F.col("label").cast(e.schema["label"].dataType).alias("label"), "vec_id", (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("distance"))  # halves by the double, as in the SQL


CELL_SQL = """cells as (select p_size % 20 as map_id, p_partkey as cell_id, cos(radians(p_partkey % 181 - 90)) * cos(radians(p_partkey * 7 % 360)) as x, cos(radians(p_partkey % 181 - 90)) * sin(radians(p_partkey * 7 % 360)) as y, sin(radians(p_partkey % 181 - 90)) as z,
case when p_partkey % 11 = 0 then 0.0 else p_size::double end as area, floor(p_retailprice / 100) as prob, p_retailprice as distmu, p_size::double as distsigma from part)"""


def cells(spark, d):
    p = load(spark, d, "part")
    x, y, z = C.unit_vector(F.col("p_partkey") * 7 % 360, F.col("p_partkey") % 181 - 90)
    return p.select((F.col("p_size") % 20).alias("map_id"), F.col("p_partkey").alias("cell_id"), x.alias("x"), y.alias("y"), z.alias("z"), F.when(F.col("p_partkey") % 11 == 0, 0.0).otherwise(F.col("p_size").cast("double")).alias("area"), F.floor(F.col("p_retailprice") / 100).cast("double").alias("prob"), F.col("p_retailprice").alias("distmu"), F.col("p_size").cast("double").alias("distsigma"))


def credible(spark, d):
    return Y.credible_levels(cells(spark, d)).select("map_id", "cell_id", F.round("level", 6).alias("level"))


def area(spark, d):
    return Y.credible_area(cells(spark, d), 0.5).select("map_id", F.round("area", 4).alias("area"))


def nearest_cell(spark, d):
    s = load(spark, d, "supplier")
    x, y, z = C.unit_vector(F.col("s_suppkey") * 13 % 360, F.col("s_suppkey") % 121 - 60)
    pts = s.select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 20).cast("int").alias("map_id"), x.alias("px"), y.alias("py"), z.alias("pz"))
    return Y.nearest_cell(pts, cells(spark, d))


def tile(spark, d):
    return Y.tiles(cells(spark, d), 60.0).groupBy("map_id", "tile").agg(F.count("*").alias("n"), F.sum("prob").alias("prob"))


def classes(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") % 25).alias("snr"), (F.col("p_retailprice") / 3).alias("area"))
    return p.groupBy(Y.classify(p, "snr", "area").alias("kind")).agg(F.count("*").alias("n"))


def sky_summary(spark, d):
    return Y.summary(cells(spark, d)).select("map_id", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def uniq(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.lit(4).cast("long") * F.pow(F.lit(4.0), F.col("p_size") % 9).cast("long") + F.col("p_partkey") % 12).alias("uniq"))
    o = C.uniq_order(F.col("uniq"))
    return p.select("p_partkey", o.alias("order"), C.uniq_pixel(F.col("uniq"), o).alias("pixel"), F.round(C.pixel_area_deg2(o), 6).alias("area"))


def sphere(spark, d):
    c = load(spark, d, "customer")
    return c.select(C.ang2pix_ring(16, (F.col("c_custkey") * 17 % 360).cast("double"), (F.col("c_custkey") * 7 % 179 - 89).cast("double")).alias("pixel")).groupBy("pixel").agg(F.count("*").alias("n"))


def least_hash(spark, d):
    return S.least_hash(load(spark, d, "orders"), 3, by=["o_custkey"], key=["o_orderkey"], seed="pick").select("o_custkey", "o_orderkey")


def strat_split(spark, d):
    return S.stratified_split(load(spark, d, "supplier"), 0.2, by=["s_nationkey"], key=["s_suppkey"], seed="split").select("s_suppkey", "part")


def proportional(spark, d):
    return S.proportional(cells(spark, d), 5, by=["map_id"], weight="prob", key=["cell_id"], seed="pps").select("map_id", "cell_id")


def quota(spark, d):
    c = load(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return S.largest_remainder(c, 333, bin_="p_size", count="n")


def quota_sample(spark, d):
    p = load(spark, d, "part")
    q = S.largest_remainder(p.groupBy("p_size").agg(F.count("*").alias("n")), 333, bin_="p_size", count="n")
    return S.by_quota(p, q, bin_="p_size", key=["p_partkey"], seed="quota").select("p_size", "p_partkey")


def galleries(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", "value")
    return S.prefix_galleries(e, [2, 5, 10], by=["user_id"], order=["value", "event_id"]).select("user_id", "size", "slot", "event_id")


def blocks(spark, d):
    return S.block_sample(load(spark, d, "customer"), "c_custkey", 100, 420, "blocks").select("c_custkey")


def shift(spark, d):
    return S.circular_shift(load(spark, d, "supplier"), 2, by=["s_nationkey"], order=["s_suppkey"], value="s_suppkey").select("s_suppkey", "shifted")


def batched(spark, d):
    return S.batches(load(spark, d, "customer"), 64, by=["c_mktsegment"], key=["c_custkey"], seed="batch").select("c_custkey", "batch")


def pivoted(spark, d):
    o = load(spark, d, "orders")
    t = o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))
    return t.select("o_orderpriority", "F", "O", "P", F.round(F.col("O") - F.col("F"), 4).alias("delta"))


def seed_mean(spark, d):
    """Mean of the seeds' means: every seed counts alike, however many rows it has."""
    o = load(spark, d, "orders").withColumn("seed", F.col("o_custkey") % 3)
    s = o.groupBy("o_orderpriority", "seed").agg(F.avg("o_totalprice").alias("m"))
    return s.groupBy("o_orderpriority").agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 4).alias("mean"))


def two_level(spark, d):
    li = load(spark, d, "lineitem")
    a = li.groupBy("l_suppkey", "l_orderkey").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    return a.groupBy("l_suppkey").agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("orders"), F.sum("n").alias("lines"))


def scopes(spark, d):
    """Overall, by region and by nation in one pass."""
    c, n = load(spark, d, "customer"), load(spark, d, "nation")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # a fixed table
    r = j.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    return r.select(F.coalesce("n_regionkey", F.lit(-1)).alias("region"), F.coalesce("n_nationkey", F.lit(-1)).alias("nation"), "n", "mean")


def quantile_summary(spark, d):
    o = load(spark, d, "orders")
    qs = (0.01, 0.05, 0.5, 0.95, 0.99)
    g = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"), F.percentile("o_totalprice", F.array(*[F.lit(q) for q in qs])).alias("q"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return g.select("o_orderstatus", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *[F.round(F.col("q")[k], 4).alias(f"q{int(q * 100):02d}") for k, q in enumerate(qs)], "lo", "hi")


def balance(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    u = li.unpivot("l_returnflag", ["l_quantity", "l_discount", "l_tax"], "feature", "v")
    g = u.groupBy("l_returnflag", "feature").agg(F.min("v").alias("lo"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.max("v").alias("hi"))
    return g.select("l_returnflag", "feature", "lo", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p90"), "hi")


def grouped_list(spark, d):
    n = load(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_nationkey")), ",").alias("nations"))


def embedding_quality(spark, d):
    """Mean similarity inside and between labels from sums of vectors: no pairs are formed."""
    e = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    norms = load(spark, d, "embeddings").select("label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("s")).groupBy("label").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    sums = e.groupBy("label", "k").agg(F.sum("x").alias("x"))
    intra = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("q")).join(norms, "label").where("n > 1")
    return intra.select("label", F.round((F.col("q") - F.col("s")) / (F.col("n") * (F.col("n") - 1)), 6).alias("intra"))


DU = "epoch_us(ts) + 3506716800000000"
EV = f"e as (select event_id, user_id, event_type, value, {DU} as t from events)"
DENS = f"{CELL_SQL}, dn as (select *, case when area > 0 then prob / area else 0 end as density from cells)"
LEVEL = f"{DENS}, lv as (select *, sum(prob) over (partition by map_id order by density desc range between unbounded preceding and current row) / sum(prob) over (partition by map_id) as level from dn)"
H = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::bigint"
QUOTA = """c as (select p_size, count(*) as n from part group by 1), x as (select *, n * 333.0::double / sum(n) over () as ex from c), f as (select *, floor(ex) as fl, 333 - sum(floor(ex)) over () as lft from x),
quotas as (select p_size, n, least(n, fl + (row_number() over (order by round(ex - fl, 9) desc, p_size) <= lft)::int)::bigint as quota from f)"""

QUERIES = {
    "join_fk": (fk, f"with {OBS_SQL}, {PARENT_SQL} select source, count(*) as n, round(avg(flux), 5) as mean from obs join parent using (object) group by source"),
    "join_left_fill": (left_checked, "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1"),
    "join_many_to_many": (validated_mn, "select l_suppkey % 50 as tile, count(*) as visits from lineitem, orders where l_suppkey % 50 = o_custkey % 50 group by 1"),
    "join_interval_after": (window_after, f"with {EV} select a.event_id as anchor, b.event_id, b.t - a.t as dt from e a, e b where b.t between a.t and a.t + 21600000000 and a.user_id <> b.user_id and b.value <= 60"),
    "join_interval_before": (window_before, f"with {EV} select a.event_id as anchor, count(*) as n from e a, e b where b.t between a.t - 10800000000 and a.t and a.event_id <> b.event_id group by 1"),
    "join_mismatch_fallback": (mismatch, f"with {EV} select a.event_id as anchor, coalesce(arg_min(b.event_id, (b.t, b.event_id)), -1) as pick from e a left join e b on b.t between a.t + 1 and a.t + 1800000000 and a.user_id <> b.user_id group by 1"),
    "join_two_centres": (two_centres, f"with {EV}, s as (select a.event_id as anchor, b.event_id from e a, e b, (values (-1), (1)) as v(s) where b.t between a.t + s * 43200000000 - 3600000000 and a.t + s * 43200000000 + 3600000000) select anchor, count(*) as n, min(event_id) as least from s group by 1"),
    "join_rings": (rings, f"with {EV}, p as (select a.event_id as anchor, abs(b.t - a.t) / 3600000000 as h from e a, e b where a.event_id <> b.event_id and abs(b.t - a.t) <= 28800000000) select anchor, case when h <= 1 then 0 when h <= 2 then 1 when h <= 4 then 2 else 3 end as ring, count(*) as n from p group by all"),
    "join_busy_anti": (busy_anti, f"with {EV} select event_id from e a where not exists (select 1 from e b where b.event_type = 'error' and a.t between b.t and b.t + 7200000000)"),
    "join_asof": (as_of, f"with {EV} select a.event_id, round(v.value, 6) as value, coalesce(v.t, -1) as vt from (select * from e where event_type = 'purchase') a asof left join (select * from e where event_type = 'view') v on a.user_id = v.user_id and a.t >= v.t"),
    "join_nearest": (
        nearest,
        """with p as (select p_brand, p_partkey, p_size::double as a, p_retailprice / 100.0 as b from part), d as (select q.p_partkey as q, r.p_partkey, round(sqrt(pow(r.a - q.a, 2) + pow(r.b - q.b, 2)), 9) as d from p q join p r using (p_brand) where q.p_partkey <> r.p_partkey)
        select q, arg_min(p_partkey, (d, p_partkey)) as p_partkey, round(min(d), 6) as distance from d group by q""",
    ),
    "join_division": (division, "select l_partkey from lineitem group by 1 having count(distinct l_returnflag || l_linestatus) = (select count(distinct l_returnflag || l_linestatus) from lineitem)"),
    "join_caliper": (caliper, "select a.p_partkey as i, b.p_partkey as j, abs(a.p_size - b.p_size) as dsize, round(abs(a.p_retailprice - b.p_retailprice), 4) as dprice from part a join part b on a.p_type = b.p_type and a.p_partkey < b.p_partkey and b.p_retailprice between a.p_retailprice - 20 and a.p_retailprice + 20 and abs(a.p_size - b.p_size) <= 3"),
    "emb_knn_distinct_parent": (
        knn_parents,
        """with e as (select vec_id, label, list_transform(embedding, lambda x, i: case when (vec_id + i - 1) % 7 <> 0 then x::double end) as v from embeddings),
        c as (select q.vec_id as q, e.label, e.vec_id, list_filter(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x: x is not null) as g from e, e q where q.vec_id % 20 = 0 and e.label <> q.label),
        p as (select q, label, vec_id, round(sqrt(list_sum(g) / len(g)), 9) as d from c where len(g) > 0),
        b as (select q, label, min(d) as d, arg_min(vec_id, (d, vec_id)) as vec_id from p group by all), r as (select *, row_number() over (partition by q order by d, vec_id)::int as rank from b) select q, rank, label, vec_id, round(d, 6) as distance from r where rank <= 3""",
    ),
    "sky_credible_level": (credible, f"with {LEVEL} select map_id, cell_id, round(level, 6) as level from lv"),
    "sky_credible_area": (area, f"with {LEVEL} select map_id, round(coalesce(sum(area) filter (level <= 0.5), arg_max(area, (density, -cell_id))), 4) as area from lv group by map_id"),
    "sky_nearest_cell": (
        nearest_cell,
        f"""with {CELL_SQL}, p as (select s_suppkey as point_id, s_suppkey % 20 as map_id, cos(radians(s_suppkey % 121 - 60)) * cos(radians(s_suppkey * 13 % 360)) as px, cos(radians(s_suppkey % 121 - 60)) * sin(radians(s_suppkey * 13 % 360)) as py, sin(radians(s_suppkey % 121 - 60)) as pz from supplier)
        select point_id, p.map_id::int as map_id, arg_max(cell_id, (round(px * x + py * y + pz * z, 12), -cell_id)) as cell_id from p join cells on p.map_id = cells.map_id group by all""",
    ),
    "sky_tiles": (tile, f"with {DENS}, r as (select *, row_number() over (partition by map_id order by density desc, cell_id) as rank, greatest(1, ceil(sum(area) over (partition by map_id) / 60.0)) - 1 as last from dn) select map_id, least(floor((rank - 1) * area / 60.0), last)::int as tile, count(*) as n, sum(prob) as prob from r group by all"),
    "sky_event_class": (classes, "with p as (select p_size % 25 as snr, p_retailprice / 3 as area from part) select case when snr <= 12 then 'baseline' when area <= 30 then 'gold' when area <= 100 then 'gold_scan' when area < 500 then 'silver' else 'baseline' end as kind, count(*) as n from p group by 1"),
    "sky_summary": (sky_summary, f"with {CELL_SQL} select map_id, round(sum(prob * distmu) / sum(prob), 4) as mean, round(sqrt(sum(prob * (distmu * distmu + distsigma * distsigma)) / sum(prob) - pow(sum(prob * distmu) / sum(prob), 2)), 4) as std from cells group by 1"),
    "sky_uniq": (uniq, "select p_partkey, p_size % 9 + 0 as \"order\", p_partkey % 12 as pixel, round(4 * pi() * pow(180 / pi(), 2) / (12 * pow(4, p_size % 9)), 6) as area from part where p_partkey % 12 < 12 and (p_partkey % 12 < 3 * 4 * pow(4, p_size % 9))"),
    "sphere_ang2pix": (
        sphere,
        """with p as (select sin(radians(c_custkey * 7 % 179 - 89)) as z, (c_custkey * 17 % 360) / 90.0::double as tt from customer), a as (select *, floor(16 * (0.5 + tt) - 12 * z) as jp, floor(16 * (0.5 + tt) + 12 * z) as jm, tt - floor(tt) as tp, 16 * sqrt(3 * (1 - abs(z))) as tmp from p),
        b as (select *, 17 + jp - jm as ir, floor(tp * tmp) + floor((1 - tp) * tmp) + 1 as ring from a),
        c as (select case when abs(z) <= 2.0::double / 3 then 480 + (ir - 1) * 64 + ((floor((jp + jm - 16 + (case when ir % 2 = 0 then 1 else 0 end) + 1) / 2)::bigint % 64) + 64) % 64 when z > 0 then 2 * ring * (ring - 1) + least(floor(tt * ring), 4 * ring - 1) else 3072 - 2 * ring * (ring + 1) + least(floor(tt * ring), 4 * ring - 1) end as pixel from b)
        select pixel::bigint as pixel, count(*) as n from c group by 1""",
    ),
    "sample_least_hash": (least_hash, f"with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by {H(repr('pick|') + ' || o_orderkey')}, o_orderkey) as n from orders) select o_custkey, o_orderkey from r where n <= 3"),
    "split_stratified": (strat_split, f"with r as (select s_suppkey, count(*) over (partition by s_nationkey) as n, row_number() over (partition by s_nationkey order by {H(repr('split|') + ' || s_suppkey')}, s_suppkey) as r from supplier) select s_suppkey, case when r <= case when n > 1 then least(greatest(floor(n * 0.2), 1), n - 1) else 0 end then 'val' else 'train' end as part from r"),
    "sample_proportional": (proportional, f"with {CELL_SQL}, r as (select map_id, cell_id, row_number() over (partition by map_id order by round(-ln(({H(repr('pps|') + ' || cell_id')} + 1) / 4294967297.0::double) / prob, 9), cell_id) as n from cells where prob > 0) select map_id, cell_id from r where n <= 5"),
    "agg_quota": (quota, f"with {QUOTA} select p_size, n, quota from quotas"),
    "sample_by_quota": (quota_sample, f"with {QUOTA}, r as (select p_size, p_partkey, quota, row_number() over (partition by p_size order by {H(repr('quota|') + ' || p_partkey')}, p_partkey) as k from part join quotas using (p_size)) select p_size, p_partkey from r where k <= quota"),
    "ret_prefix_galleries": (galleries, "with r as (select user_id, event_id, row_number() over (partition by user_id order by value, event_id)::int as slot from events) select user_id, size, slot, event_id from r, (values (2), (5), (10)) as s(size) where slot <= size - 1"),
    "sample_blocks": (
        blocks,
        f"""with b as (select c_custkey // 100 as b, count(*) as size from customer group by 1), h as (select *, coalesce(sum(size) over (order by {H(repr('blocks|') + ' || b')}, b rows between unbounded preceding and 1 preceding), 0) as before from b),
        r as (select c_custkey, before, row_number() over (partition by b order by c_custkey) as k from customer join h on c_custkey // 100 = b where before < 420) select c_custkey from r where before + k <= 420""",
    ),
    "sample_circular_shift": (shift, "with r as (select *, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as r, count(*) over (partition by s_nationkey) as n from supplier) select a.s_suppkey, b.s_suppkey as shifted from r a join r b on a.s_nationkey = b.s_nationkey and (a.r + 2) % a.n = b.r"),
    "sample_batches": (batched, f"select c_custkey, (row_number() over (partition by c_mktsegment order by {H(repr('batch|') + ' || c_custkey')}, c_custkey) - 1) // 64 as batch from customer"),
    "agg_pivot_delta": (pivoted, "with p as (select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as f, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as o, round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as p from orders group by 1) select o_orderpriority, f as \"F\", o as \"O\", p as \"P\", round(o - f, 4) as delta from p"),
    "agg_seed_mean": (seed_mean, "with s as (select o_orderpriority, o_custkey % 3 as seed, avg(o_totalprice) as m from orders group by all) select o_orderpriority, count(*) as seeds, round(avg(m), 4) as mean from s group by 1"),
    "agg_two_level": (two_level, "with a as (select l_suppkey, l_orderkey, avg(l_discount) as m, count(*) as n from lineitem group by all) select l_suppkey, round(avg(m), 6) as mean, count(*) as orders, sum(n)::bigint as lines from a group by 1"),
    "agg_rollup": (scopes, "select coalesce(n_regionkey, -1) as region, coalesce(n_nationkey, -1) as nation, count(*) as n, round(avg(c_acctbal), 4) as mean from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)"),
    "agg_quantiles": (quantile_summary, "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as std, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) as q{int(q * 100):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + ", min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1"),
    "agg_matching_balance": (balance, "with u as (unpivot (select l_returnflag, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name feature value v) select l_returnflag, feature, min(v) as lo, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.9), 6) as p90, max(v) as hi from u group by all"),
    "agg_group_list": (grouped_list, "select n_regionkey, string_agg(n_nationkey::varchar, ',' order by n_nationkey) as nations from nation group by 1"),
    "emb_intra_similarity": (embedding_quality, "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings) select a.label, round(avg(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))), 6) as intra from e a join e b on a.label = b.label and a.vec_id <> b.vec_id group by 1"),
}
