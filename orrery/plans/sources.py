"""Queries of what sources and writers produce, on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import scans as A
from ..sources import shards as S
from .tables import load


def offsets(spark, d):
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    heads = o.select((F.col("o_orderkey") % 7).alias("shard"), F.col("o_orderkey").alias("key"))
    rows = li.where("l_quantity > 10").select((F.col("l_orderkey") % 7).alias("shard"), F.col("l_orderkey").alias("key"), "l_linenumber")
    return S.with_offsets(heads, rows, by=["shard"], key="key").select("shard", "key", "start", "count")


def compacted(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    old = o.where("o_orderkey % 3 <> 0").withColumn("at", F.lit(1))
    new = o.where("o_orderkey % 2 = 0").withColumn("at", F.lit(2)).withColumn("o_totalprice", -F.col("o_totalprice"))
    catalog = o.where("o_orderkey % 11 <> 0").select("o_orderkey", (1_000_000 - F.col("o_orderkey")).alias("order"))
    return S.compacted([old, new], catalog, key="o_orderkey", newest=["at"], order="order").select("o_orderkey", "o_totalprice", "at", "place")


def tables(spark, d):
    c = load(spark, d, "customer").where("c_custkey % 4 <> 1").select("c_custkey", "c_name")
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return S.dataset(c, o, li, parent="c_custkey", curve="o_orderkey", least=4)


def dataset_curves(spark, d):
    return tables(spark, d)[1].select("c_custkey", "o_orderkey", "n_obs", "parent_idx", "curve_idx")


def dataset_events(spark, d):
    return tables(spark, d)[0].select("c_custkey", "parent_idx")


def with_parent(spark, d):
    p = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    c = load(spark, d, "orders").select(F.col("o_orderkey").alias("curve"), F.col("o_custkey").alias("c_custkey"))
    return S.with_parent(c, p, key="c_custkey", negatives=p, seed="neg").select("curve", "c_custkey", "parent_nation", "negative_key", "negative_nation")


def library(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("libid"), (F.col("s_suppkey") * 17 % 360 * 1.0).alias("ra"), (F.col("s_suppkey") % 90 - 45.0).alias("dec"))
    p = load(spark, d, "part").select((F.col("p_partkey") % 100 + 1).alias("libid"), (60000 + F.col("p_size") * 0.5).alias("mjd"), F.col("p_partkey").alias("id"), F.substring("p_brand", 7, 1).alias("band"), (F.col("p_size") / 4.0).alias("zero"))
    heads = s.join(p.groupBy("libid").agg(F.count("*").alias("n")), "libid")
    return S.library_lines(heads, p, key="libid")


def documents(spark, d):
    template = "NAME: x\nSEED: 1\nMASS: ?\nNOTE: keep"
    p = load(spark, d, "part")
    return p.select("p_partkey", S.filled(template, {"NAME": F.col("p_name"), "SEED": F.col("p_partkey"), "MASS": F.format_string("%.2f", F.col("p_size") / 3.0)}).alias("text"))


def wide_table(spark, d):
    o = load(spark, d, "orders").where("not (o_orderstatus = 'P' and o_orderpriority like '3%')").groupBy("o_orderpriority", "o_orderstatus").agg((F.avg("o_totalprice") / 1e6).alias("v"))
    return S.result_table(o, line="o_orderpriority", column="o_orderstatus", value="v", columns=["F", "O", "P"])


def selected(spark, d):
    wanted = load(spark, d, "lineitem").where("l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return A.selected_rows(load(spark, d, "part").select("p_partkey", "p_size"), wanted, "p_partkey")


LIKE = {
    "promo": {"p_type": "PROMO%", "p_name": "%red%"}, "large": {"p_type": "%LARGE%", "p_brand": "%#1%", "p_name": "%blue%"}, "steel": {"p_type": "%STEEL"},
    "small": {"p_type": "SMALL%"}, "brass": {"p_type": "%BRASS"}, "green": {"p_name": "%green%"}, "tin": {"p_type": "%TIN", "p_name": "tin%"}, "never": {"p_name": "%zzz%"},
}


def like_any(spark, d):
    return A.like_any(load(spark, d, "part"), "p_partkey", LIKE).select("p_partkey", "label")


def medians(spark, d):
    p = load(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("a"), F.when(F.col("p_size") == 5, None).when(F.col("p_size") == 6, F.lit(float("-inf"))).otherwise(F.col("p_size").cast("double")).alias("b"))
    m = A.posterior_medians(p, ["a", "b"], by=["p_brand"])
    return m.select("p_brand", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "finite")


def distribution(spark, d):
    p = load(spark, d, "part").groupBy((F.col("p_size") - 3).alias("k")).agg(F.count("*").alias("n"))
    h = A.histogram_distribution(p, bin_="k", n="n")
    return h.select("k", F.round("p", 9).alias("p"), F.round("upto", 9).alias("upto"))


def study(spark, d):
    o = load(spark, d, "orders")
    trials = o.select((F.col("o_custkey") % 50).alias("trial"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("COMPLETE").alias("state"), F.col("o_totalprice").alias("objective"))
    params = load(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("trial"), F.concat(F.lit("p"), F.col("s_nationkey") % 3).alias("name"), F.col("s_acctbal").alias("value"))
    return A.study_trials(trials, params, ["p0", "p1", "p2"]).select("trial", "objective", "p0", "p1", "p2")


def log_lines(spark, d):
    e = load(spark, d, "events").select("event_id", F.concat(F.lit("step="), F.col("event_id").cast("string"), F.lit(" loss="), F.round("value", 2).cast("string"), F.when(F.col("event_id") % 3 == 0, " step=0 loss=1.5").otherwise("")).alias("value"))
    m = A.matching_lines(e, r"step=(\d+) loss=([0-9.]+)", ["step", "loss"])
    return m.select("event_id", F.col("step").cast("long").alias("step"), F.round(F.col("loss").cast("double"), 4).alias("loss"))


def folders(spark, d):
    p = load(spark, d, "part")
    return p.groupBy(A.folder_class(F.col("p_type"), {"steel": "hard", "promo": "cheap", "s": "other"}).alias("kind")).agg(F.count("*").alias("n"))


LIKE_SQL = " union all ".join(f"select p_partkey, '{name}' as label from part where {' or '.join(f'{c} like {x!r}' for c, x in p.items())}" for name, p in LIKE.items())
H = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::bigint"
DATA_SQL = """n as (select l_orderkey as o, count(*) as n from lineitem group by 1 having count(*) >= 4), k as (select o_custkey as c, o_orderkey as o, n from orders join n on o = o_orderkey where o_custkey in (select c_custkey from customer where c_custkey % 4 <> 1))"""

QUERIES = {
    "snk_shard_offsets": (
        offsets,
        """with c as (select l_orderkey as k, count(*) as n from lineitem where l_quantity > 10 group by 1), h as (select o_orderkey % 7 as shard, o_orderkey as key, coalesce(n, 0) as n from orders left join c on k = o_orderkey)
        select shard, key, coalesce(sum(n) over (partition by shard order by key rows between unbounded preceding and 1 preceding), 0)::bigint as start, n as count from h""",
    ),
    "snk_compacted": (
        compacted,
        "select o_orderkey, case when o_orderkey % 2 = 0 then -o_totalprice else o_totalprice end as o_totalprice, case when o_orderkey % 2 = 0 then 2 else 1 end as at, 1000000 - o_orderkey as place from orders where o_orderkey % 11 <> 0 and (o_orderkey % 2 = 0 or o_orderkey % 3 <> 0)",
    ),
    "snk_dataset_curves": (dataset_curves, f"with {DATA_SQL} select c as c_custkey, o as o_orderkey, n as n_obs, dense_rank() over (order by c) - 1 as parent_idx, dense_rank() over (order by o) - 1 as curve_idx from k"),
    "snk_dataset_events": (dataset_events, f"with {DATA_SQL} select c as c_custkey, row_number() over (order by c) - 1 as parent_idx from (select distinct c from k) x"),
    "src_with_parent": (
        with_parent,
        f"""with p as (select c_custkey as c, c_nationkey as nation, row_number() over (order by {H("'neg|0|' || c_custkey")}, c_custkey) - 1 as pos, count(*) over () as n from customer),
        o as (select o_orderkey as curve, p.*, (pos + 1 + {H("'neg|' || o_orderkey")} % greatest(n - 1, 1)) % n as at from orders join p on c = o_custkey)
        select curve, o.c as c_custkey, o.nation as parent_nation, q.c as negative_key, q.nation as negative_nation from o join p q on q.pos = o.at""",
    ),
    "snk_library_lines": (
        library,
        """with p as (select p_partkey % 100 + 1 as k, 60000 + p_size * 0.5::double as mjd, p_partkey as id, substr(p_brand, 7, 1) as band, p_size / 4.0::double as z from part), h as (select s_suppkey as k, s_suppkey * 17 % 360 as ra, s_suppkey % 90 - 45 as de, n from supplier join (select k, count(*) as n from p group by 1) c on k = s_suppkey),
        l as (select k, 0 as part, 0 as tm, 0 as id, printf('LIBID: %d RA: %.4f DEC: %.4f NOBS: %d', k, ra::double, de::double, n) as line from h union all select k, 1, mjd, id, printf('S: %10.4f %9d %-1s %6.2f', mjd, id, band, z) from p union all select k, 2, 0, 0, 'END_LIBID: ' || k from h)
        select k as libid, row_number() over (partition by k order by part, tm, id)::int as number, line from l where k in (select k from h) or part = 1""",
    ),
    "snk_template_document": (documents, "select p_partkey, 'NAME: ' || p_name || chr(10) || 'SEED: ' || p_partkey || chr(10) || 'MASS: ' || printf('%.2f', p_size / 3.0::double) || chr(10) || 'NOTE: keep' as text from part"),
    "snk_result_table": (
        wide_table,
        r"""with v as (select o_orderpriority as p, avg(o_totalprice) filter (o_orderstatus = 'F') / 1e6 as f, avg(o_totalprice) filter (o_orderstatus = 'O') / 1e6 as o, avg(o_totalprice) filter (o_orderstatus = 'P' and o_orderpriority not like '3%') / 1e6 as x from orders group by 1), t as (select *, coalesce(printf('%.4f', f), '--') as tf, coalesce(printf('%.4f', o), '--') as tt, coalesce(printf('%.4f', x), '--') as tx from v)
        select p as o_orderpriority, tf as "F", tt as "O", tx as "P", p || ' & ' || case when f = max(f) over () then '\textbf{' || tf || '}' else tf end || ' & ' || case when o = max(o) over () then '\textbf{' || tt || '}' else tt end || ' & ' || case when x = max(x) over () then '\textbf{' || tx || '}' else tx end || ' \\' as latex from t""",
    ),
    "src_selected_rows": (selected, "select p_partkey, p_size from part where p_partkey in (select l_partkey from lineitem where l_discount = 0.1)"),
    "src_like_any": (like_any, LIKE_SQL),
    "src_posterior_medians": (
        medians,
        "select p_brand, round(quantile_cont(p_retailprice, 0.5) filter (p_partkey % 9 <> 0), 4) as a, round(quantile_cont(p_size, 0.5) filter (p_size not in (5, 6)), 4) as b, count(*) filter (p_partkey % 9 <> 0 and p_size not in (5, 6)) as finite from part group by 1",
    ),
    "src_distribution": (distribution, "with h as (select p_size - 3 as k, count(*) as n from part where p_size >= 3 group by 1) select k, round(n / sum(n) over (), 9) as p, round(sum(n) over (order by k) / sum(n) over (), 9) as upto from h"),
    "src_study_trials": (
        study,
        """with l as (select o_custkey % 50 as trial, arg_max(o_orderstatus, o_orderkey) as s, arg_max(o_totalprice, o_orderkey) as objective from orders group by 1), w as (select s_suppkey % 50 as trial, s_nationkey % 3 as k, max(s_acctbal) as v from supplier group by all)
        select trial, any_value(objective) as objective, max(v) filter (k = 0) as p0, max(v) filter (k = 1) as p1, max(v) filter (k = 2) as p2 from l left join w using (trial) where s <> 'P' group by trial""",
    ),
    "src_log_lines": (log_lines, "select event_id, event_id as step, round(value, 2) as loss from events union all select event_id, 0, 1.5 from events where event_id % 3 = 0"),
    "src_folder_class": (folders, "select case when lower(p_type) like '%steel%' then 'hard' when lower(p_type) like '%promo%' then 'cheap' when lower(p_type) like '%s%' then 'other' else 'unknown' end as kind, count(*) as n from part group by 1"),
}
