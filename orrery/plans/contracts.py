"""Contract queries: each lists its rules with the rows that break them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as V
from .tables import load


def labels(spark, d):
    p = load(spark, d, "part").select(F.when(F.col("p_partkey") % 13 != 0, F.when(F.col("p_partkey") % 5 == 0, "no_ejecta").otherwise("none")).alias("label"), (F.col("p_partkey") % 5 * 0.01).alias("a"), (F.col("p_size") % 4 * 0.01).alias("b"))
    return V.label_consistency(p, label="label", a="a", b="b")


def ranges(spark, d):
    p = load(spark, d, "part").select(F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") / 100.0).otherwise(F.lit(float("nan"))).alias("dynamic"), (F.col("p_retailprice") / 20000.0).alias("wind"))
    return V.model_range(p, {"dynamic": (0.005, 0.3), "wind": (0.05, 0.09)})


def files(spark, d):
    s = load(spark, d, "supplier")
    rows = s.select("s_suppkey", F.concat(F.lit("maps/"), F.when(F.col("s_suppkey") % 9 == 0, F.lit("x")).otherwise(F.col("s_suppkey").cast("string")), F.lit(".fits")).alias("file"))
    there = s.where("s_suppkey % 7 <> 0").select(F.concat(F.lit("maps/"), F.col("s_suppkey").cast("string"), F.lit(".fits")).alias("path"))
    return V.referenced_files(rows, there, key="s_suppkey", path="file")


def namespace(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.lit("bns").alias("source"), F.lit("test").alias("split"), F.when(F.col("o_orderkey") % 11 == 0, "odd").otherwise("negative").alias("kind"))
    o = o.withColumn("uid", F.concat_ws("_", "source", "split", "kind", F.when(F.col("o_orderkey") % 50 == 0, F.lit(1)).otherwise(F.col("o_orderkey")).cast("string")))
    return V.namespace(o, key="o_orderkey", source="source", split="split", kind="kind", uid="uid", kinds=["negative", "positive"])


def payload(spark, d):
    """Orders as heads with counts and offsets of their line items; every 29th says one too many."""
    from pyspark.sql.window import Window

    li = load(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") == 13, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double")).alias("v"))
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = n.withColumn("__part", F.col("l_orderkey") % 64)
    w = Window.partitionBy("__part").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    heads = n.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("n", F.col("n") + F.when(F.col("l_orderkey") % 29 == 0, 1).otherwise(0))
    return V.payload(heads, li, key="l_orderkey", start="start", count="n", value="v")


def aggregate(spark, d):
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("lost")
    events = o.where("o_orderkey % 31 <> 0").select("o_orderkey", F.col("o_orderkey").alias("place"), status.alias("status"), F.when(F.col("o_orderkey") % 37 != 0, F.col("o_orderpriority")).alias("plan"))
    catalog = o.where("o_orderkey % 41 <> 0").select("o_orderkey", (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 43 == 0, 1).otherwise(0)).alias("place"))
    return V.against_catalog(events, catalog, key="o_orderkey", order="place", status="status", plan="plan")


def handoff(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return V.handed_off(c.withColumn("c_name", F.when(F.col("c_custkey") == 7, "other").otherwise(F.col("c_name"))), c.orderBy(F.desc("c_custkey")), ["c_custkey", "c_name"])


def covered(spark, d):
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("s"))
    events = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 10 == 3, None).when(F.col("c_nationkey") < 20, "success").otherwise("failed").alias("status"))
    return V.coverage(events, o.where("s = 'F'"), key="o_custkey", status="status")


def requests(spark, d):
    p = load(spark, d, "part").select(F.when(F.col("p_partkey") % 100 == 1, F.lit(1)).otherwise(F.col("p_partkey")).cast("long").alias("id"), F.when(F.col("p_size") == 9, F.lit(float("inf"))).otherwise(F.col("p_retailprice")).alias("mass"), (F.col("p_size") - 3.0).alias("snr"))
    wanted = load(spark, d, "lineitem").select((F.col("l_partkey") + 5).alias("id"))
    return V.requested(p, wanted, key="id", finite=["mass"], snr="snr")


def compatible(spark, d):
    s = load(spark, d, "supplier").groupBy((F.col("s_suppkey") % 3).alias("seed")).agg(F.max("s_nationkey").alias("nations"), F.lit("v1").alias("profile"), F.count("*").alias("rows"), F.max("s_suppkey").alias("last"))
    return V.compatible(s, run="seed", fields=["nations", "profile", "rows", "last"])


def edges(spark, d):
    p = load(spark, d, "part").groupBy("p_brand", F.floor(F.col("p_size") / 10).alias("bin")).agg(F.count("*").alias("n"))
    p = p.select("p_brand", "bin", (F.col("bin") * 10).alias("low"), (F.col("bin") * 10 + F.when(F.col("n") % 7 == 0, 0).when(F.col("n") % 5 == 0, 9).otherwise(10)).alias("high"))
    return V.edges(p, by=["p_brand"], order="bin", low="low", high="high")


def scenarios(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 400).alias("libid"), (F.col("o_orderkey") % 9 == 0).alias("truth"))
    return V.scenario_faults(o, scenario="o_custkey", constant=["o_orderstatus", "o_orderpriority"], unique="libid", truth="truth")


def one_to_one(spark, d):
    o = load(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    f, p = (o.where(F.col("o_orderstatus") == s).select("o_orderpriority", F.round("m", 4).alias("m")) for s in "FO")
    return V.one_to_one(f, p, ["o_orderpriority"], ("_new", "_base"))


def collapse(spark, d, part=0):
    li = load(spark, d, "lineitem").select("l_suppkey", (F.col("l_suppkey") % 25).alias("nation"), "l_discount", "l_linestatus")
    return V.collapsed(li, ["l_suppkey"], first=["nation"], mean=["l_discount"], repeat="l_linestatus")[part]


def collapse_rows(spark, d):
    return collapse(spark, d).withColumn("l_discount", F.round("l_discount", 8))


def collapse_rules(spark, d):
    return collapse(spark, d, 1)


def many_to_one(spark, d):
    n = load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = V.many_to_one(load(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"], required=["n_name"])
    return j.groupBy("n_name").agg(F.count("*").alias("n"))


def required(spark, d):
    s = load(spark, d, "supplier").withColumn("empty", F.lit(None).cast("string"))
    return V.required_columns(s, ["s_suppkey", "S_NAME", "empty", "absent"])


def physics(spark, d):
    p = load(spark, d, "part").select(
        (F.col("p_size") / 20.0).alias("m1"), (F.col("p_partkey") % 40 / 20.0).alias("m2"), (F.col("p_partkey") % 23 / 10.0 - 1.1).alias("chi"), (F.col("p_partkey") % 64 / 10.0).alias("ra"), (F.col("p_partkey") % 33 / 10.0 - 1.6).alias("dec"),
        (F.col("p_size") / 100.0).alias("a"), (F.col("p_retailprice") / 1e5).alias("b"), (F.col("p_size") / 100.0 + F.col("p_retailprice") / 1e5 + F.when(F.col("p_partkey") % 19 == 0, 1e-6).otherwise(0.0)).alias("t"), (F.col("p_size") - 2.0).alias("snr"),
    )
    return V.physics(p, heavy="m1", light="m2", spins=["chi"], ra="ra", dec="dec", total="t", parts=["a", "b"], snr="snr")


def rules_sql(source: str, rules: dict[str, str]) -> str:
    """The rules one by one, each as its own count."""
    return f"with {source} " + " union all ".join(f"select '{name}' as rule, count(*) filter (not coalesce({ok}, false)) as n from x" for name, ok in rules.items())


FINITE = lambda c: f"({c} is not null and isfinite({c}))"
QUERIES = {
    "val_label_consistency": (
        labels,
        rules_sql("x as (select case when p_partkey % 13 <> 0 then case when p_partkey % 5 = 0 then 'no_ejecta' else 'none' end end as l, p_partkey % 5 = 0 and p_size % 4 = 0 as z from part)", {"label_without_zero": "l is null or l <> 'no_ejecta' or z", "zero_without_label": "l is null or l = 'no_ejecta' or not z"}),
    ),
    "val_model_range": (
        ranges,
        rules_sql("x as (select case when p_partkey % 17 <> 0 then p_size / 100.0::double else 'nan'::double end as a, p_retailprice / 20000.0 as b from part)", {"dynamic_in_range": f"{FINITE('a')} and a >= 0.005 and a <= 0.3", "wind_in_range": "b >= 0.05 and b <= 0.09"}),
    ),
    "val_referenced_files": (
        files,
        rules_sql("l as (select 'maps/' || s_suppkey || '.fits' as p from supplier where s_suppkey % 7 <> 0), x as (select s_suppkey as k, 'maps/' || case when s_suppkey % 9 = 0 then 'x' else s_suppkey::varchar end || '.fits' as f from supplier)", {"file_exists": "f in (select p from l)", "file_name": "f = 'maps/' || k || '.fits'"}),
    ),
    "val_stream_namespace": (
        namespace,
        rules_sql(
            "o as (select o_orderkey as k, case when o_orderkey % 11 = 0 then 'odd' else 'negative' end as kind from orders), u as (select *, 'bns_test_' || kind || '_' || case when k % 50 = 0 then 1 else k end as uid from o), x as (select *, count(*) over (partition by uid) as n from u)",
            {"known_class": "kind <> 'odd'", "canonical_uid": "k % 50 <> 0 or k = 1", "unique_uid": "n = 1"},
        ),
    ),
    "val_payload": (
        payload,
        rules_sql(
            "c as (select l_orderkey as k, count(*) as n, count(*) filter (l_quantity = 13) as bad from lineitem group by 1), s as (select *, coalesce(sum(n) over (partition by k % 64 order by k rows between unbounded preceding and 1 preceding), 0) as start, n + case when k % 29 = 0 then 1 else 0 end as said from c), x as (select *, coalesce(sum(said) over (partition by k % 64 order by k rows between unbounded preceding and 1 preceding), 0) as before from s)",
            {"count": "said = n", "offset": "start = before", "finite": "bad = 0", "nonempty": "said > 0"},
        ),
    ),
    "val_against_catalog": (
        aggregate,
        rules_sql(
            "x as (select o_orderkey as k, o_orderkey % 31 <> 0 as e, o_orderkey % 41 <> 0 as c, o_orderstatus as s from orders where o_orderkey % 31 <> 0 or o_orderkey % 41 <> 0)",
            {"missing": "e", "unknown": "c", "once": "true", "order": "not e or not c or k % 43 <> 0", "status": "not e or s in ('F', 'O')", "plan": "not e or s <> 'F' or k % 37 <> 0"},
        ),
    ),
    "val_handoff": (handoff, "select 'rows' as \"check\", true as same union all select 'digest', count(*) filter (c_custkey = 7) = 0 from customer union all select 'schema', true"),
    "val_coverage": (
        covered,
        rules_sql(
            "f as (select o_custkey from orders group by 1 having min(o_orderstatus) = 'F'), x as (select c_custkey in (select o_custkey from f) as has, case when c_custkey % 10 = 3 then null when c_nationkey < 20 then 'success' else 'failed' end as s from customer)",
            {"success_without_rows": "coalesce(s, '') <> 'success' or has", "rows_without_success": "not has or s is null or s = 'success'", "legacy": "s is not null"},
        ),
    ),
    "val_requested": (
        requests,
        rules_sql(
            "p as (select case when p_partkey % 100 = 1 then 1 else p_partkey end as id, p_size from part), w as (select distinct l_partkey + 5 as id from lineitem), j as (select w.id, p.id as pid, p_size from w left join p using (id)), x as (select *, count(pid) over (partition by id) as n from j)",
            {"present": "pid is not null", "unique": "n <= 1", "finite": "pid is null or p_size <> 9", "signal": "pid is null or p_size >= 3"},
        ),
    ),
    "val_compatible_runs": (
        compatible,
        """with s as (select s_suppkey % 3 as seed, max(s_nationkey)::varchar as nations, 'v1' as profile, count(*)::varchar as n, max(s_suppkey)::varchar as last from supplier group by 1), x as (select count(distinct nations) as a, count(distinct profile) as b, count(distinct n) as c, count(distinct last) as d from s)
        select 'nations' as field, a as "values", a = 1 as same from x union all select 'profile', b, b = 1 from x union all select 'rows', c, c = 1 from x union all select 'last', d, d = 1 from x""",
    ),
    "val_bin_edges": (
        edges,
        rules_sql(
            "g as (select p_brand, p_size // 10 as b, count(*) as n from part group by all), h as (select p_brand, b, b * 10 as lo, b * 10 + case when n % 7 = 0 then 0 when n % 5 = 0 then 9 else 10 end as hi from g), x as (select *, lag(hi) over (partition by p_brand order by b) as last from h)",
            {"rising": "lo < hi", "joined": "last is null or last = lo"},
        ),
    ),
    "val_scenarios": (
        scenarios,
        rules_sql("x as (select o_custkey, count(distinct o_orderstatus) as a, count(distinct o_orderpriority) as b, count(*) as n, count(distinct o_orderkey % 400) as u, count(*) filter (o_orderkey % 9 = 0) as t from orders group by 1)", {"constant_o_orderstatus": "a = 1", "constant_o_orderpriority": "b = 1", "unique_id": "u = n", "one_truth": "t = 1"}),
    ),
    "join_validated_left": (many_to_one, "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1"),
    "val_required_columns": (required, "select rule, n from (values ('s_suppkey', 0::bigint), ('S_NAME', 0), ('empty', 1), ('absent', 1)) as v(rule, n)"),
    "val_physics": (
        physics,
        rules_sql(
            "x as (select p_size / 20.0::double as m1, p_partkey % 40 / 20.0::double as m2, p_partkey % 23 as chi, p_partkey % 64 as ra, p_partkey % 33 as de, p_partkey % 19 <> 0 as t, p_size >= 2 as s from part)",
            {"masses": "m1 >= m2 and m2 > 0", "chi": "chi between 1 and 21", "ra": "ra / 10.0::double < 2 * pi()", "dec": "abs(de / 10.0::double - 1.6) <= pi() / 2", "total": "t", "signal": "s"},
        ),
    ),
    "join_one_to_one": (one_to_one, "select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as m_new, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as m_base from orders group by 1"),
    "agg_collapse": (collapse_rows, "select l_suppkey, any_value(l_suppkey % 25) as nation, round(avg(l_discount), 8) as l_discount, count(distinct l_linestatus) as repeats from lineitem group by 1"),
    "val_collapse": (collapse_rules, rules_sql("x as (select count(distinct l_linestatus) as r from lineitem group by l_suppkey), t as (select count(distinct l_linestatus) as t from lineitem)", {"equal_coverage": "r = (select t from t)", "constant_nation": "true"})),
}
