"""Queries of curves, parents and what is told about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import curves as K
from ..operators import metrics as M
from ..operators import vectors as V
from .lightcurves import BANDS
from .tables import load


def redshifts(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * F.col("p_size") / 10).alias("r"))
    return K.with_redshift(p, "r").select("p_partkey", F.round("redshift", 5).alias("redshift"))


def degrees(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.radians(F.col("c_custkey") % 360).alias("ra"), F.radians(F.col("c_custkey") % 181 - 90).alias("dec"))
    return K.as_degrees(c, "ra", "dec").select("c_custkey", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


def hash64(spark, d):
    return load(spark, d, "orders").select("o_orderkey", K.hash64(C.key_of("id", F.col("o_orderkey"))).cast("string").alias("h"))


def seeds(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return K.seeds(s, seed=7, parts=["s_nationkey", "s_suppkey"], names=["sky", "noise"])


def scenarios(spark, d):
    return K.scenarios(load(spark, d, "supplier").select("s_suppkey"), 4, key="s_suppkey", start=60000.0, step=365.25)


def window_needed(spark, d):
    b = load(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return K.needs_window(b, low="lo", high="hi", window=(0.0, 99.95)).select("event_type", "crop")


def of_parents(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return K.of_parents(o, load(spark, d, "customer"), key="c_custkey", ok=F.col("c_acctbal") > 5000).groupBy("c_custkey").agg(F.count("*").alias("n"))


def manifest(spark, d):
    m = load(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4 + 1).alias("k"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return K.manifest_rows(m, li, key="l_orderkey", order=["l_linenumber", "l_partkey"], k="k").groupBy("l_orderkey", "k").agg(F.count("*").alias("n"))


def long_curves(spark, d):
    g = load(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("r1"), F.round(F.max("o_totalprice"), 4).alias("r5"), F.max(F.when(F.col("o_orderpriority") == "5-LOW", 1.0)).alias("m0"))
    return K.long_curves(g, ["o_orderpriority"], {"r1": ("recall", 1), "r5": ("recall", 5), "m0": ("mrr", 0)})


def pair_times(spark, d):
    e = load(spark, d, "events").select("event_id", "user_id", C.micros(F.col("ts")).alias("t"))
    return K.pair_times(e, key="event_id", time="t", group="user_id", width=12 * 3_600_000_000)


def time_summary(spark, d):
    o = load(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, 0.0).when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 1000).alias("dt"))
    r = K.time_summary(o, "dt", by=["o_orderstatus"])
    return r.select("o_orderstatus", "n", *[F.round(c, 6).alias(c) for c in r.columns[2:]])


def recounted(spark, d):
    b = C.softening(F.lit(24.7))
    flux, error = F.col("value") * 10 - 200, 1.0 + F.col("event_id") % 90
    e = load(spark, d, "events").select(F.col("user_id").alias("object"), C.luptitude(flux, b).alias("mag"), C.luptitude_error(flux, error, b).alias("err"), (flux / error).alias("known"))
    return K.recounted(e, softening=b, threshold=4.9, known=F.col("known"))


def valid_share(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 != 0, F.col("value")).alias("s"))
    r = K.valid_share(e, by=["user_id"], score="s", band="event_type", bands=BANDS)
    return r.select("user_id", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


def coordinates(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("s_acctbal") * k).alias("v"))
    return K.coordinates(s, 3, {"mode": "native", "tile": -1}, "v").select("s_suppkey", F.col("index"), F.round("value", 4).alias("value"), "mode", "tile")


def quality(spark, d):
    return K.similarity_summary(load(spark, d, "embeddings"), parent="label", vector="embedding").select(F.round("alignment", 6).alias("alignment"), F.round("gap", 6).alias("gap"))


def directions(spark, d):
    """Ranks of a query's next vector among all rows by dot product, and of the query among all for its next: both directions."""
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9)
    out = None
    for name, step in (("forward", 1), ("backward", -1)):
        q = e.where("vec_id % 20 = 5").select(F.col("vec_id").alias("q"), F.col("v").alias("qv"))
        pos = q.join(e.select((F.col("vec_id") - step).alias("q"), F.col("v").alias("pv")), "q").select("q", "qv", dot("qv", "pv").alias("ps"))
        g = V.higher(pos.withColumnRenamed("qv", "v"), e, query="q", row="vec_id", vector="v", score="ps", but=step).select("q", (F.col("above") + 1).alias("rank"))
        g = g.agg(F.lit(name).alias("direction"), F.count("*").alias("n"), *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_at_{k}") for k in (1, 5, 50)], F.round(F.avg(1.0 / F.col("rank")), 6).alias("mrr"))
        out = g if out is None else out.unionByName(g)
    return out


def audit(spark, d):
    from .joins import knn_parents

    return K.neighbour_audit(knn_parents(spark, d), 2, query="q", rank="rank", row="vec_id", distance="distance")


def batches(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return K.batches_of(s, 16, stratum="s_nationkey", key="s_suppkey", seed="turns").select("s_suppkey", "batch")


def composite(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.concat_ws("_", F.col("o_orderstatus"), F.lit("test"), (F.col("o_custkey") % 200).cast("string")).alias("uid"))
    known = load(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("O").alias("source"), F.lit("test").alias("split"), F.col("s_suppkey").alias("id"), "s_name")
    return K.composite_lookup(o, known, "uid", fields=["source", "split", "id"]).groupBy("found").agg(F.count("*").alias("n"), F.count_distinct("s_name").alias("names"))


def canonical(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name"))
    return n.select("n_nationkey", F.sha2(C.canonical_json("name", "n_nationkey"), 256).alias("digest"))


def classified(spark, d):
    """Accuracy and AUROC of each seed over all rows and over each source, then their means over seeds."""
    e = load(spark, d, "events").select((F.col("event_id") % 3).alias("seed"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("scope"), (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("score"), (F.col("event_id") * 31 % 10 < 3 + F.col("event_id") * 7919 % 1000 / 200).cast("int").alias("label"))
    e = e.unionByName(e.withColumn("scope", F.lit("all")))
    j = M.auroc(e, by=["seed", "scope"]).join(M.confusion(e, by=["seed", "scope"]), ["seed", "scope"])
    return j.groupBy("scope").agg(F.count("*").alias("seeds"), F.round(F.avg("auroc"), 6).alias("auroc"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("f1"))


def metadata(spark, d):
    c = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("t"), "l_returnflag")
    m = K.pairing_metadata(c, load(spark, d, "customer"), li, curve="o_orderkey", parent="c_custkey", source="c_nationkey", time="t", band="l_returnflag", bands=3)
    return m.select("o_orderkey", "c_custkey", "c_nationkey", *[F.round(x, 7).alias(x) for x in m.columns[3:]])


def batch_galleries(spark, d):
    return K.batch_galleries(load(spark, d, "events"), batch=F.floor(F.col("event_id") / 32), key="event_id", size=4, seed="gal")


def band_indices(spark, d):
    token = F.element_at(F.array(*[F.lit(x) for x in ("LSST-u", "g", "lsst-r", "i", " z", "y", "Y", "LSST-Y", "G", "w")]), (F.col("p_partkey") % 10 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", C.band_index(token).alias("band"))


def hash_split(spark, d):
    """A tenth of the keys, whatever else is in the table, by the key's hash modulo 10,000."""
    o = load(spark, d, "orders")
    return o.groupBy((C.hash32(C.key_of("split", F.col("o_orderkey"))) % 10_000 < 1000).alias("held")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def first_columns(spark, d):
    """The first of several names that the table has, whatever its case."""
    from ..operators import catalog as K_

    c = load(spark, d, "customer")
    return c.select("c_custkey", K_.first_column(c, ["balance", "C_AcctBal", "c_name"]).alias("x"), (K_.first_column(c, ["none"]) if K_.first_column(c, ["none"]) is not None else F.lit(None).cast("double")).alias("y"))


def caliper_quantile(spark, d):
    """Pairs of parts of a type within calipers of size and price, of these the nearer half of each type by summed distance."""
    from ..operators import intervals as I

    p = load(spark, d, "part").select("p_type", "p_partkey", "p_size", "p_retailprice")
    distance = F.round(F.col("dstep") / 6 + F.abs(F.col("a") - F.col("b")) / 30, 6)
    return I.caliper_part(p, 0.5, key="p_partkey", on=["p_type"], step="p_size", steps=6, at="p_retailprice", width=30, distance=distance).select("p_type", "i", "j", "d")


def meta_filter(spark, d):
    """Curves by their own constraints, each with what it drops alone."""
    m = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_det"), F.count_distinct("l_returnflag").alias("n_bands"), (F.max("l_quantity") - F.min("l_quantity")).cast("double").alias("t_span"))
    return K.constrained(m, {"n_det": (2, None), "n_bands": (2, 3), "t_span": (5.0, 45.0)})[1]


H = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::bigint"
DOT = "round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 9)"
B_SOFT = "(pow(10, 0.4 * (31.4 - 24.7)) / 5)"
INVERSE = "1 / sqrt(0.30966 * pow(1 + z, 3) + 0.69034)"

QUERIES = {
    "f_redshift": (
        redshifts,
        f"""with s as (select k * 0.001953125::double as z from range(0, 4097) as r(k)), i as (select z, {INVERSE} as f, lead({INVERSE}) over (order by z) as g, 1 / sqrt(0.30966 * pow(1.0009765625 + z, 3) + 0.69034) as m from s),
        c as (select z, 299792.458 / 67.66 * coalesce(sum((f + 4 * m + g) * 0.001953125 / 6) over (order by z rows between unbounded preceding and 1 preceding), 0) * (1 + z) as d from i), t as (select d as a, lead(d) over (order by z) as b, z from c), p as (select p_partkey, p_retailprice * p_size / 10 as r from part)
        select p_partkey, round(z + 0.001953125 * (r - a) / (b - a), 5) as redshift from p join t on r >= a and r < b""",
    ),
    "f_degrees": (degrees, "select c_custkey, round((c_custkey % 360)::double, 6) as ra, round((c_custkey % 181 - 90)::double, 6) as dec from customer".replace(" as dec", ' as "dec"')),
    "f_hash64": (
        hash64,
        "with h as (select o_orderkey, sha256('id|' || o_orderkey) as h from orders) select o_orderkey, list_sum(list_transform(range(0, 8), lambda k: ('0x' || substr(h, (2 * k + 1)::int, 2))::hugeint * pow(2::double, 8 * k)::hugeint))::hugeint::varchar as h from h",
    ),
    "smp_seeds": (seeds, f"select s_suppkey, s_nationkey, {H(repr('7|') + ' || s_nationkey || ' + repr('|') + ' || s_suppkey || ' + repr('|sky'))} as sky, {H(repr('7|') + ' || s_nationkey || ' + repr('|') + ' || s_suppkey || ' + repr('|noise'))} as noise from supplier"),
    "smp_scenarios": (scenarios, "select s_suppkey, k::int as scenario, s_suppkey * 4 + k as libid, 60000.0::double + k * 365.25::double as trigger from supplier, range(0, 4) as r(k)"),
    "flt_window_needed": (window_needed, "select event_type, min(value) < 0 or max(value) > 99.95 as crop from events group by 1"),
    "flt_of_parents": (of_parents, "select o_custkey as c_custkey, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000) group by 1"),
    "opx_manifest_rows": (manifest, "select o_orderkey as l_orderkey, o_custkey % 4 + 1 as k, least(o_custkey % 4 + 1, (select count(*) from lineitem where l_orderkey = o_orderkey)) as n from orders where o_orderkey % 2 = 0 and o_orderkey in (select l_orderkey from lineitem)"),
    "prj_long_curves": (
        long_curves,
        "with g as (select o_orderpriority as p, round(avg(o_totalprice), 4) as a, round(max(o_totalprice), 4) as b from orders group by 1) select p as o_orderpriority, 'recall' as metric, 1 as at, a as value from g union all select p, 'recall', 5, b from g union all select p, 'mrr', 0, 1.0 from g where p = '5-LOW'",
    ),
    "opx_pair_times": (
        pair_times,
        "with e as (select event_id, user_id, epoch_us(ts) + 3506716800000000 as t, min(epoch_us(ts) + 3506716800000000) over (partition by user_id) as f from events) select a.user_id, a.event_id as a, b.event_id as b, b.t - a.t as actual, b.t - a.f as relative from e a join e b on a.user_id = b.user_id and b.t between a.t and a.t + 43200000000 and a.event_id <> b.event_id",
    ),
    "opx_time_summary": (
        time_summary,
        "with o as (select o_orderstatus, case when o_orderkey % 9 = 0 then 0 when o_orderkey % 10 <> 0 then o_totalprice / 1000 end as t from orders) select o_orderstatus, count(t) as n, round(avg(t), 6) as mean, round(stddev_pop(t), 6) as std, round(quantile_cont(t, 0.05), 6) as q05, round(quantile_cont(t, 0.5), 6) as q50, round(quantile_cont(t, 0.95), 6) as q95, round(count(*) filter (t = 0) / count(t), 6) as zero from o group by 1",
    ),
    "opx_recounted": (recounted, "select user_id as object, count(*) as n_obs, count(*) filter ((value * 10 - 200) / (1 + event_id % 90) > 4.9) as n_det from events group by 1"),
    "opx_valid_share": (valid_share, "with e as (select user_id, event_type as k, (event_id % 6 <> 0 and event_id % 7 <> 0)::int as ok from events) select user_id, round(avg(ok), 6) as valid, " + ", ".join(f"round(avg(ok) filter (k = '{b}'), 6) as v_{b}" for b in BANDS) + " from e group by 1"),
    "opx_coordinates": (coordinates, "select s_suppkey, k::int as \"index\", round(s_acctbal * (k + 1), 4) as value, 'native' as mode, -1 as tile from supplier, range(0, 3) as r(k)"),
    "emb_alignment": (
        quality,
        """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select a.label, avg(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as m from e a join e b on a.label = b.label and a.vec_id <> b.vec_id group by 1),
        c as (select k, avg(x) as m from (select unnest(v) as x, unnest(range(0, len(v))) as k from e) y group by 1) select round((select avg(m) from p), 6) as alignment, round((select sqrt(sum(m * m)) from c), 6) as gap""",
    ),
    "ret_directions": (
        directions,
        f"""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select b.vec_id as q, a.vec_id as r, {DOT} as s from e a, e b where b.vec_id % 20 = 5 and a.vec_id <> b.vec_id),
        k as (select 'forward' as direction, x.q, count(*) filter (y.s > x.s) + 1 as rank from s x join s y on x.q = y.q and y.r <> x.r where x.r = x.q + 1 group by x.q union all select 'backward', x.q, count(*) filter (y.s > x.s) + 1 from s x join s y on x.q = y.q and y.r <> x.r where x.r = x.q - 1 group by x.q)
        select direction, count(*) as n, round(avg((rank <= 1)::int), 6) as recall_at_1, round(avg((rank <= 5)::int), 6) as recall_at_5, round(avg((rank <= 50)::int), 6) as recall_at_50, round(avg(1.0::double / rank), 6) as mrr from k group by 1""",
    ),
    "opx_neighbour_audit": (audit, None),
    "smp_turn_batches": (
        batches,
        f"with t as (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by {H(repr('turns|') + ' || s_suppkey')}, s_suppkey) as t from supplier) select s_suppkey, (row_number() over (order by t, s_nationkey, s_suppkey) - 1) // 16 as batch from t",
    ),
    "join_composite_lookup": (
        composite,
        "with o as (select o_orderstatus as s, o_custkey % 200 as i from orders), k as (select case when s_suppkey % 2 = 0 then 'F' else 'O' end as s, s_suppkey as i, s_name from supplier) select k.i is not null as found, count(*) as n, count(distinct s_name) as names from o left join k on o.s = k.s and o.i = k.i group by 1",
    ),
    "text_canonical_json": (canonical, """select n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"name":' || case when n_nationkey % 4 <> 0 then '"' || n_name || '"' else 'null' end || '}') as digest from nation"""),
    "opx_pair_metadata": (
        metadata,
        """with f as (select l_orderkey as o, ln(1 + count(*)) as log_n, count(distinct l_returnflag) / 3 as band_share, ln(1 + max(l_quantity) - min(l_quantity)) as log_span from lineitem group by 1), j as (select o, o_custkey as c, c_nationkey, log_n, band_share, log_span from orders join f on o = o_orderkey join customer on c_custkey = o_custkey),
        m as (select c, quantile_cont(log_n, 0.5) as a, quantile_cont(band_share, 0.5) as b, quantile_cont(log_span, 0.5) as s from j group by 1)
        select o as o_orderkey, j.c as c_custkey, c_nationkey, round(log_n, 7) as log_n, round(band_share, 7) as band_share, round(log_span, 7) as log_span, round(a, 7) as median_log_n, round(b, 7) as median_band_share, round(s, 7) as median_log_span from j join m on j.c = m.c""",
    ),
    "opx_batch_galleries": (
        batch_galleries,
        f"""with b as (select event_id as q, event_id // 32 as b, row_number() over (partition by event_id // 32 order by {H(repr('gal|') + ' || event_id')}, event_id) - 1 as p, count(*) over (partition by event_id // 32) as n from events)
        select a.q as query, s::int as slot, c.q as row from b a, range(0, 4) as r(s), b c where a.b = c.b and c.p = (a.p + s) % a.n and s < a.n""",
    ),
    "f_band_index": (band_indices, "select p_partkey, [0, 1, null, 3, 4, 5, 5, 5, null, null][p_partkey % 10 + 1]::int as band from part"),
    "split_by_hash": (hash_split, f"select {H(repr('split|') + ' || o_orderkey')} % 10000 < 1000 as held, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1"),
    "prj_first_column": (first_columns, "select c_custkey, c_acctbal as x, null::double as y from customer"),
    "join_caliper_quantile": (
        caliper_quantile,
        """with e as (select a.p_type, a.p_partkey as i, b.p_partkey as j, round(abs(a.p_size - b.p_size) / 6 + abs(a.p_retailprice - b.p_retailprice) / 30, 6) as d from part a join part b on a.p_type = b.p_type and a.p_partkey < b.p_partkey and b.p_retailprice between a.p_retailprice - 30 and a.p_retailprice + 30 and abs(a.p_size - b.p_size) <= 6),
        q as (select p_type, quantile_cont(d, 0.5) as m from e group by 1) select p_type, i, j, d from e join q using (p_type) where d <= m""",
    ),
    "flt_meta_constraints": (
        meta_filter,
        """with m as (select count(*) as n, count(distinct l_returnflag) as b, (max(l_quantity) - min(l_quantity))::double as t from lineitem group by l_orderkey)
        select 'n_det' as rule, count(*) filter (n < 2) as dropped, count(*) filter (n >= 2 and b between 2 and 3 and t between 5 and 45) as kept from m union all select 'n_bands', count(*) filter (b not between 2 and 3), count(*) filter (n >= 2 and b between 2 and 3 and t between 5 and 45) from m
        union all select 't_span', count(*) filter (t not between 5 and 45), count(*) filter (n >= 2 and b between 2 and 3 and t between 5 and 45) from m""",
    ),
    "cls_scope_summary": (
        classified,
        """with e as (select event_id % 3 as seed, 's' || user_id % 3 as scope, event_id * 7919 % 1000 / 1000.0::double as s, (event_id * 31 % 10 < 3 + event_id * 7919 % 1000 / 200)::int as y from events), a as (select * from e union all select seed, 'all', s, y from e),
        r as (select *, rank() over (partition by seed, scope order by s) + (count(*) over (partition by seed, scope, s) - 1) / 2.0::double as k from a),
        g as (select seed, scope, (sum(k) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::double) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc, avg(((s >= 0.5)::int = y)::int) as acc, 2.0::double * count(*) filter (s >= 0.5 and y = 1) / (count(*) filter (s >= 0.5) + count(*) filter (y = 1)) as f1 from r group by all)
        select scope, count(*) as seeds, round(avg(auc), 6) as auroc, round(avg(acc), 6) as accuracy, round(avg(f1), 6) as f1 from g group by 1""",
    ),
}
