"""Catalogue queries: projections, filters, contracts and set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C
from ..operators import catalog as K
from .tables import load


def derived(spark, d):
    c = load(spark, d, "customer")
    ra = F.radians(F.col("c_custkey") % 360)
    dec = F.radians(F.col("c_custkey") % 181 - 90)
    x, y, z = C.unit_vector(ra, dec, degrees=False)
    back_ra, back_dec = C.ra_dec(x, y, z)
    return c.select("c_custkey", F.round(F.degrees(ra), 6).alias("ra_deg"), F.round(F.abs(F.cos(dec)), 6).alias("abs_cos"), F.round(back_ra, 5).alias("ra_back"), F.round(back_dec, 5).alias("dec_back"), C.hash32(C.key_of("seed", F.col("c_custkey"))).alias("seed"))


def gps(spark, d):
    o = load(spark, d, "orders")
    g = F.col("o_orderkey") * F.lit(1_000_003) % F.lit(1_400_000_000)
    return o.select("o_orderkey", g.alias("gps"), F.round(C.gps_to_mjd(g), 8).alias("mjd"))


def normalised(spark, d):
    o = load(spark, d, "orders")
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("o_totalprice") / 250000.0 - 1)))
    return o.select("o_orderkey", F.round(F.when(F.col("o_orderkey") % 3 == 0, theta).otherwise(F.lit(0.5)), 6).alias("inclination"), K.clean_label(F.when(F.col("o_orderkey") % 5 == 0, " NaN ").otherwise(F.col("o_orderpriority"))).alias("label"), K.parse_bool(F.when(F.col("o_orderkey") % 2 == 0, " True").otherwise("0")).alias("flag"))


def completed(spark, d):
    s = load(spark, d, "supplier").withColumn("bad", F.concat(F.lit("x"), "s_name"))
    return K.complete(s, {"s_suppkey": ("bigint", None), "bad": ("double", None), "s_acctbal": ("double", 0.0), "mode": ("string", "native"), "tile": ("int", -1)})


def physical(spark, d):
    p = load(spark, d, "part")
    m1, m2 = F.greatest(F.col("p_size"), F.col("p_partkey") % 40 + 1).cast("double"), F.least(F.col("p_size"), F.col("p_partkey") % 40 + 1).cast("double")
    s1, s2 = (F.col("p_partkey") % 19 - 9) / 10.0, (F.col("p_partkey") % 7 - 3) / 10.0
    chirp = F.pow(m1 * m2, F.lit(0.6)) / F.pow(m1 + m2, F.lit(0.2))
    return p.select("p_partkey", F.round(chirp, 6).alias("chirp"), F.round(m2 / m1, 6).alias("q"), F.round((m1 * s1 + m2 * s2) / (m1 + m2), 6).alias("chi_eff"), F.round(F.log10("p_retailprice"), 6).alias("log_distance"))


RANGES = {"l_quantity": (5.0, 40.0), "l_discount": (0.02, 0.08)}


def ranged(spark, d):
    return K.range_audit(load(spark, d, "lineitem"), RANGES)[0].select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def range_counts(spark, d):
    return K.range_audit(load(spark, d, "lineitem"), RANGES)[1]


def semi(spark, d):
    done = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, d, "lineitem").join(done, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


def dedupe(spark, d):
    return K.dedupe_first(load(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def latest(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return K.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def json_status(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", F.from_json("props", "k long").alias("p"))
    return K.latest(e.select("user_id", "event_id", F.col("p.k").alias("k")).where("k is not null"), ["user_id"], ["event_id"]).select("user_id", "k")


def status_counts(spark, d):
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    last = K.latest(o.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    j = c.join(last, c["c_custkey"] == last["o_custkey"], "left").select(F.coalesce("o_orderstatus", F.lit("unprocessed")).alias("status"))
    return j.groupBy("status").agg(F.count("*").alias("n"))


def contracts(spark, d):
    li = load(spark, d, "lineitem")
    rules = {"quantity": F.col("l_quantity") <= 49, "discount": F.col("l_discount").between(0.0, 0.09), "price": F.col("l_extendedprice") >= F.col("l_quantity") * 100, "integral": F.col("l_quantity") == F.floor("l_quantity")}
    return K.offenders(li, rules)


def duplicates(spark, d):
    return K.duplicate_keys(load(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


def offsets(spark, d):
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("supp"))
    before = Window.partitionBy("supp").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    made = li.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.when(F.col("l_orderkey") % 97 == 0, 1).otherwise(0))
    return K.offsets_valid(made, by=["supp"], order=["l_orderkey"], start="start", count="n").where("not valid").select("l_orderkey", "start")


def upserted(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    changes = s.where("s_suppkey % 10 = 0").withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1, 2)).unionByName(s.where("s_suppkey % 25 = 0 and s_suppkey % 10 <> 0").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))
    return K.upsert(s, changes, ["s_suppkey"])


def resume(spark, d):
    return K.remaining(load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders").where("o_orderstatus in ('F', 'O')").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


def outer_union(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = load(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


def intersect(spark, d):
    li = load(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_returnflag = 'A'").select("l_partkey")).intersect(li.where("l_returnflag = 'N'").select("l_partkey"))


def split_disjoint(spark, d):
    o = load(spark, d, "orders")
    h = C.hash32(C.key_of("split", F.col("o_orderkey"))) % 10000
    return o.select("o_orderkey", F.when(h < 8000, "train").when(h < 9000, "val").otherwise("test").alias("part"))


def uid(spark, d):
    o = load(spark, d, "orders")
    made = o.select("o_orderkey", F.concat_ws("_", F.col("o_orderstatus"), F.lit("test"), F.col("o_orderkey")).alias("uid"))
    return made.select("o_orderkey", F.regexp_extract("uid", r"^(.*)_(\d+)$", 1).alias("stream"), F.regexp_extract("uid", r"^(.*)_(\d+)$", 2).cast("long").alias("id"))


def detectors(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(F.lit("H1L1V1"), F.lit("H1L1"), F.lit("H1H1"), F.lit("K9L1")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("ifos"))
    found = F.regexp_extract_all("ifos", F.lit(r"([A-Z]\d)"), F.lit(1))
    return s.select("s_suppkey", F.size(found).alias("n"), ((F.size(F.array_distinct(found)) == F.size(found)) & (F.size(F.array_except(found, F.array(*[F.lit(x) for x in ("H1", "L1", "V1", "K1")]))) == 0)).alias("valid"))


def digests(spark, d):
    return load(spark, d, "nation").select("n_nationkey", K.digest("n_nationkey", "n_name", "n_regionkey").alias("digest"))


def transient_types(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.lower("p_type").alias("t"))
    kind = F.when(F.col("t").contains("small"), "SNIa").when(F.col("t").contains("promo"), "KN").when(F.col("t").contains("large"), "TDE").otherwise(F.regexp_replace("t", "[^a-z0-9]+", "_"))
    return p.select("p_partkey", kind.alias("kind"))


def urls(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.size(F.split("url", "/")).alias("parts"))


def tokens(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("dt"), F.regexp_replace(F.format_string("%.2f", F.abs("value")), r"\.", "p")).alias("condition"), F.aggregate(F.transform(F.split(F.lit("1,2,5"), ","), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x).alias("total"))


def code_table(spark, d):
    o = load(spark, d, "orders").select("o_orderpriority").distinct()
    return o.select("o_orderpriority", (F.dense_rank().over(Window.orderBy("o_orderpriority")) - 1).alias("code"))  # distinct labels only


QUERIES = {
    "catalog_derived": (
        derived,
        """with a as (select c_custkey, radians(c_custkey % 360) as ra, radians(c_custkey % 181 - 90) as dec from customer), v as (select *, cos(dec) * cos(ra) as x, cos(dec) * sin(ra) as y, sin(dec) as z from a)
        select c_custkey, round(degrees(ra), 6) as ra_deg, round(abs(cos(dec)), 6) as abs_cos, round(case when degrees(atan2(y, x)) < 0 then degrees(atan2(y, x)) + 360 else degrees(atan2(y, x)) end, 5) as ra_back,
        round(degrees(asin(greatest(-1.0, least(1.0, z / sqrt(x * x + y * y + z * z))))), 5) as dec_back, ('0x' || substr(sha256('seed|' || c_custkey), 1, 8))::bigint as seed from v""",
    ),
    "catalog_gps_to_mjd": (gps, f"""with l(s, n) as (values {", ".join(map(str, C.LEAPS))}), g as (select o_orderkey, o_orderkey * 1000003 % 1400000000 as gps from orders) select o_orderkey, gps, round(44244.0 + (gps - max(n)) / 86400.0::double, 8) as mjd from g join l on gps >= s group by o_orderkey, gps"""),
    "catalog_normalised": (
        normalised,
        """select o_orderkey, round(case when o_orderkey % 3 = 0 then acos(greatest(-1.0, least(1.0, o_totalprice / 250000.0 - 1))) else 0.5 end, 6) as inclination,
        case when o_orderkey % 5 = 0 then 'unknown' else lower(trim(o_orderpriority)) end as label, o_orderkey % 2 = 0 as flag from orders""",
    ),
    "catalog_completed": (completed, "select s_suppkey, null::double as bad, s_acctbal, 'native' as mode, -1 as tile from supplier"),
    "catalog_physical": (
        physical,
        """with a as (select p_partkey, p_retailprice, greatest(p_size, p_partkey % 40 + 1)::double as m1, least(p_size, p_partkey % 40 + 1)::double as m2, (p_partkey % 19 - 9) / 10.0::double as s1, (p_partkey % 7 - 3) / 10.0::double as s2 from part)
        select p_partkey, round(pow(m1 * m2, 0.6) / pow(m1 + m2, 0.2), 6) as chirp, round(m2 / m1, 6) as q, round((m1 * s1 + m2 * s2) / (m1 + m2), 6) as chi_eff, round(log10(p_retailprice), 6) as log_distance from a""",
    ),
    "catalog_range_filter": (ranged, "select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity between 5 and 40 and l_discount between 0.02 and 0.08"),
    "catalog_range_audit": (range_counts, "select count(*) filter (l_quantity between 5 and 40 and l_discount between 0.02 and 0.08) as kept, count(*) filter (not l_quantity between 5 and 40) as outside_l_quantity, count(*) filter (not l_discount between 0.02 and 0.08) as outside_l_discount from lineitem"),
    "catalog_success_semi": (semi, "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')"),
    "catalog_dedupe_first": (dedupe, "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1"),
    "win_latest": (latest, "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1"),
    "json_latest_status": (json_status, "select user_id, max_by((props->>'k')::bigint, event_id) as k from events where props->>'k' is not null group by user_id"),
    "agg_status_counts": (status_counts, "with l as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders group by 1) select coalesce(s, 'unprocessed') as status, count(*) as n from customer left join l on c_custkey = o_custkey group by 1"),
    "val_contracts": (
        contracts,
        """select rule, n from (select count(*) filter (not l_quantity <= 49) as quantity, count(*) filter (not l_discount between 0.0 and 0.09) as discount, count(*) filter (not l_extendedprice >= l_quantity * 100) as price, count(*) filter (not l_quantity = floor(l_quantity)) as integral from lineitem)
        unpivot (n for rule in (quantity, discount, price, integral)) where n > 0""",
    ),
    "val_duplicate_keys": (duplicates, "select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1"),
    "win_csr_offsets": (offsets, """with a as (select l_orderkey, count(*) as n, min(l_suppkey) as supp from lineitem group by 1), b as (select *, coalesce(sum(n) over (partition by supp order by l_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as right_ from a) select l_orderkey, right_ + 1 as start from b where l_orderkey % 97 = 0"""),
    "snk_upsert": (upserted, "select case when s_suppkey % 25 = 0 and s_suppkey % 10 <> 0 and k = 1 then s_suppkey + 1000000 else s_suppkey end as s_suppkey, case when s_suppkey % 10 = 0 then round(s_acctbal + 1, 2) else s_acctbal end as s_acctbal from supplier, range(0, 2) as r(k) where k = 0 or (s_suppkey % 25 = 0 and s_suppkey % 10 <> 0)"),
    "set_resume": (resume, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus in ('F', 'O'))"),
    "set_outer_union": (outer_union, "select c_custkey as id, c_acctbal as balance, c_mktsegment from customer union all select -s_suppkey - 1, s_acctbal, null from supplier"),
    "set_intersect": (intersect, "select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'N'"),
    "split_disjoint": (split_disjoint, "with h as (select o_orderkey, ('0x' || substr(sha256('split|' || o_orderkey), 1, 8))::bigint % 10000 as h from orders) select o_orderkey, case when h < 8000 then 'train' when h < 9000 then 'val' else 'test' end as part from h"),
    "text_event_uid": (uid, "select o_orderkey, o_orderstatus || '_test' as stream, o_orderkey as id from orders"),
    "text_detectors": (detectors, "select s_suppkey, case s_suppkey % 4 when 0 then 3 else 2 end as n, s_suppkey % 4 in (0, 1) as valid from supplier"),
    "text_digest": (digests, "select n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) as digest from nation"),
    "text_transient_type": (transient_types, "select p_partkey, case when lower(p_type) like '%small%' then 'SNIa' when lower(p_type) like '%promo%' then 'KN' when lower(p_type) like '%large%' then 'TDE' else regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') end as kind from part"),
    "text_page_url": (urls, "select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, len(string_split(url, '/'))::int as parts from pages"),
    "text_condition_token": (tokens, "select event_id, 'dt' || replace(printf('%.2f', abs(value)), '.', 'p') as condition, 8 as total from events"),
    "catalog_code_table": (code_table, "select o_orderpriority, (dense_rank() over (order by o_orderpriority) - 1)::int as code from (select distinct o_orderpriority from orders)"),
}
