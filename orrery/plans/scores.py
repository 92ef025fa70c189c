"""Classification, ranking and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C
from ..operators import metrics as M
from ..operators import resampling as R
from ..operators import vectors as V
from .tables import load

PRED_SQL = "pred as (select user_id % 5 as source, event_id, (event_id * 7919 % 1000) / 1000.0::double as score, case when (event_id * 31 + user_id) % 10 < 3 + (event_id * 7919 % 1000) // 250 then 1 else 0 end as label from events)"
CURVE_SQL = f"""{PRED_SQL}, c as (select source, score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from pred group by all),
k as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by source) as pp, sum(n) over (partition by source) as nn from c window w as (partition by source order by score desc))"""


def pred(spark, d):
    e = load(spark, d, "events")
    s = F.col("event_id") * 7919 % 1000
    label = ((F.col("event_id") * 31 + F.col("user_id")) % 10 < 3 + F.floor(s / 250)).cast("int")
    return e.select((F.col("user_id") % 5).alias("source"), "event_id", (s / F.lit(1000.0)).alias("score"), label.alias("label"))


def auroc(spark, d):
    return M.auroc(pred(spark, d), by=["source"]).select("source", F.round("auroc", 6).alias("auroc"))


def auprc(spark, d):
    return M.auprc(pred(spark, d), by=["source"]).select("source", F.round("auprc", 6).alias("auprc"))


def best_f1(spark, d):
    return M.best_f1(pred(spark, d), by=["source"]).select("source", F.round("f1", 6).alias("f1"), "threshold")


def recall_threshold(spark, d):
    return M.threshold_for_recall(pred(spark, d), 0.9, by=["source"])


def ece(spark, d):
    return M.calibration_error(pred(spark, d), by=["source"]).select("source", F.round("ece", 6).alias("ece"))


def confusion(spark, d):
    out = M.confusion(pred(spark, d), by=["source"])
    return out.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def macro_gap(spark, d):
    c = M.confusion(pred(spark, d), by=["source"])
    return c.agg(F.round(F.avg("accuracy"), 6).alias("macro"), F.round(F.max("accuracy") - F.min("accuracy"), 6).alias("gap"), F.round(F.min("recall"), 6).alias("worst_recall"))


def dt_bins(spark, d):
    edges = [0.0, 0.1, 0.3, 0.6, 0.999]
    p = pred(spark, d).withColumn("bin", C.in_bins(F.col("score"), edges))
    return p.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("rate"))


def prefix_buckets(spark, d):
    p = pred(spark, d).withColumn("k", (F.col("event_id") % 9 + 1).cast("int"))
    named = F.array(*[F.when(F.col("k") == i, F.lit(f"k{i}")) for i in range(2, 6)], F.when(F.col("k") >= 6, F.lit("k6plus")), F.lit("terminal"))
    return p.withColumn("bucket", F.explode(F.filter(named, lambda x: x.isNotNull()))).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == (F.col("score") >= 0.5).cast("int")).cast("double")), 6).alias("accuracy"))


GALLERY_SQL = "g as (select user_id as gallery, event_id, event_id = min(event_id) over (partition by user_id) as is_positive, (event_id * 13 % 20) / 20.0::double as score from events)"


def gallery(spark, d):
    e = load(spark, d, "events")
    first = F.min("event_id").over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("gallery"), "event_id", (F.col("event_id") == first).alias("is_positive"), (F.col("event_id") * 13 % 20 / F.lit(20.0)).alias("score"))


def tie_ranks(spark, d):
    r = M.expected_rank(gallery(spark, d), by=["gallery"])
    return r.select("gallery", "above", "tied", "size", *[F.round(M.expected_recall(k), 6).alias(f"recall_at_{k}") for k in (1, 5, 10)], F.round(M.expected_reciprocal_rank(), 6).alias("mrr"))


def gallery_scopes(spark, d):
    r = M.expected_rank(gallery(spark, d), by=["gallery"]).withColumn("source", F.col("gallery") % 4).withColumn("r5", M.expected_recall(5)).withColumn("rr", M.expected_reciprocal_rank())
    sets = r.cube("source").agg(F.grouping("source").cast("int").alias("overall"), F.count("*").alias("n"), F.round(F.avg("r5"), 6).alias("recall_at_5"), F.round(F.avg("rr"), 6).alias("mrr"), F.min("size").alias("least"), F.max("size").alias("most"))
    return sets.withColumn("source", F.coalesce("source", F.lit(-1)).cast("long"))


def log_weighted(spark, d):
    r = M.expected_rank(gallery(spark, d), by=["gallery"]).withColumn("source", F.col("gallery") % 4).withColumn("rr", M.expected_reciprocal_rank())
    return M.harmonic_macro(r, by=["source"], size="size", value="rr").select("source", F.round("macro", 6).alias("macro"))


def retrieval(spark, d):
    """Recall at k, MRR and mAP of the embeddings' neighbours with the query's label, a block of queries against all."""
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("v").alias("qv"))
    pairs = V.against_all(q, e, query="q", row="vec_id").where("vec_id <> q")
    sim = F.round(F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 9)
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")
    r = pairs.select("q", "vec_id", (F.col("label") == F.col("ql")).alias("hit"), sim.alias("sim")).withColumn("rank", F.row_number().over(order))
    r = r.withColumn("hits", F.sum(F.col("hit").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = r.where("hit").groupBy("q").agg(F.min("rank").alias("first"), F.avg(F.col("hits") / F.col("rank")).alias("ap"))
    return g.select("q", "first", (F.col("first") <= 5).cast("int").alias("recall_at_5"), F.round(1.0 / F.col("first"), 6).alias("rr"), F.round("ap", 6).alias("ap"))


def spearman(spark, d):
    o = load(spark, d, "orders").select("o_orderstatus", F.round("o_totalprice", -3).alias("x"), (F.col("o_custkey") % 50).alias("y"))
    return M.spearman(o, "x", "y", by=["o_orderstatus"]).select("o_orderstatus", F.round("rho", 6).alias("rho"))


def holm(spark, d):
    s = load(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") * 37 % 100 / F.lit(1000.0)).alias("p"))
    return M.holm(s, by=["s_nationkey"], order=["s_suppkey"]).select("s_nationkey", "s_suppkey", F.round("p_holm", 6).alias("p_holm"))


def equal_count_bins(spark, d):
    o = load(spark, d, "orders")
    b = o.withColumn("bin", F.ntile(7).over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")))
    return b.groupBy("o_orderstatus", "bin").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def quartiles(spark, d):
    o = load(spark, d, "orders")
    q = o.groupBy("o_orderstatus").agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    j = o.join(F.broadcast(q), "o_orderstatus")  # one row for each of three states
    label = F.when(F.col("o_totalprice") >= F.col("q")[2], "q4").when(F.col("o_totalprice") >= F.col("q")[1], "q3").when(F.col("o_totalprice") >= F.col("q")[0], "q2").otherwise("q1")
    return j.groupBy("o_orderstatus", label.alias("quartile")).agg(F.count("*").alias("n"))


def robust(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return M.robust_scale(p, "p_retailprice", by=["p_brand"]).select("p_partkey", F.round("z", 5).alias("z"))


def trimmed(spark, d):
    return M.trimmed_mean(load(spark, d, "orders"), "o_totalprice", by=["o_orderpriority"]).select("o_orderpriority", F.round("trimmed", 4).alias("trimmed"))


def boot(spark, d):
    """Mean of the segments' means and its interval over resamples drawn within each segment."""
    c = load(spark, d, "customer")
    draws = R.stratified_means(c, stratum="c_mktsegment", key="c_custkey", value="c_acctbal", draws=100)
    real = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("m")).agg(F.round(F.avg("m"), 4).alias("mean"))
    return R.percentiles(draws, "macro", by=[]).select(F.round("q0", 4).alias("lo"), F.round("q1", 4).alias("hi")).join(F.broadcast(real))  # one row each


def flips_macro(spark, d):
    c = load(spark, d, "supplier").withColumn("v", F.col("s_acctbal") - 4500)
    return R.sign_flip_macro(c, stratum="s_nationkey", key="s_suppkey", value="v", draws=60).select(F.round("observed", 4).alias("observed"), F.round("p", 6).alias("p"))


def poisson_boot(spark, d):
    """Mean and interval of each segment by Poisson weights: one pass, no draw moves a row."""
    c = load(spark, d, "customer")
    return M.bootstrap(c, by=["c_mktsegment"], value="c_acctbal", key="c_custkey", draws=40).select("c_mktsegment", *[F.round(x, 4).alias(x) for x in ("mean", "q0", "q1")])


def group_summary(spark, d):
    li = load(spark, d, "lineitem").withColumn("v", F.col("l_discount") - F.col("l_tax"))
    return R.group_summary(li, "v", by=["l_returnflag"], group="l_suppkey").select("l_returnflag", F.round("median", 8).alias("median"), F.round("positive", 6).alias("positive"), "groups")


def mad(spark, d):
    p = load(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("x"))
    return R.location_scale(p, "x", by=["p_brand"], use="mad").select("p_brand", F.round("location", 4).alias("location"), F.round("scale", 5).alias("scale"))


def flips(spark, d):
    c = load(spark, d, "supplier").withColumn("v", F.col("s_acctbal") - 4500)
    return M.sign_flip(c, by=["s_nationkey"], value="v", key="s_suppkey", draws=50).select("s_nationkey", F.round("mean", 4).alias("mean"), F.round("p", 6).alias("p"))


def panel(spark, d):
    """Discounts as a metric: return flags are scenarios, tens of suppliers coordinates, line states models."""
    li = load(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("scenario"), (F.col("l_suppkey") % 10).alias("coordinate"), F.col("l_linestatus").alias("model")).agg(F.avg("l_discount").alias("v"))


def two_way(spark, d):
    """Scenario by coordinate bootstrap of each model."""
    s = R.two_way(panel(spark, d), scenario="scenario", coordinate="coordinate", model="model", value="v", draws=60)
    return R.percentiles(s, "m", by=["model"]).select("model", F.round("q0", 7).alias("lo"), F.round("q1", 7).alias("hi"))


def two_way_deltas(spark, d):
    s = R.two_way(panel(spark, d), scenario="scenario", coordinate="coordinate", model="model", value="v", draws=60)
    return R.paired_deltas(s, "O", model="model").select("baseline", F.round("lo", 7).alias("lo"), F.round("hi", 7).alias("hi"), F.round("positive", 6).alias("positive"))


W_POISSON = "case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3 when u < 0.9963401531726563 then 4 else 5 end"
H = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::bigint"
THRESH_SQL = lambda steps: f"""{PRED_SQL}, b as (select source, floor(score * {steps} + 1e-9)::int as k, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from pred group by all), s as (select distinct source, k from pred, range(0, {steps} + 1) as r(k)),
t as (select source, k, k / {steps}.0::double as threshold, sum(coalesce(p, 0)) over (partition by source order by k desc) as tp, sum(coalesce(n, 0)) over (partition by source order by k desc) as fp, sum(coalesce(p, 0)) over (partition by source) as pp from s left join b using (source, k))"""  # noqa: E731
RANK_SQL = f"{GALLERY_SQL}, q as (select *, max(case when is_positive then score end) over (partition by gallery) as pos from g), r as (select gallery, count(*) filter (not is_positive and score > pos) as above, count(*) filter (not is_positive and score = pos) as tied, count(*) as size from q group by gallery)"
REC = lambda k: f"least(1.0, greatest(0.0, ({k} - above) / (tied + 1.0::double)))"
RR = "list_sum(list_transform(range(above + 1, above + tied + 2), lambda x: 1.0::double / x)) / (tied + 1)"

#: Every pick of a scenario with every pick of a coordinate, written out.
TWO_WAY_SQL = f"""p as (select l_returnflag as s, l_suppkey % 10 as c, l_linestatus as model, avg(l_discount) as v from lineitem group by all),
sn as (select s, row_number() over (order by s) - 1 as k, count(*) over () as n from (select distinct s from p) x), cn as (select c, row_number() over (order by c) - 1 as k, count(*) over () as n from (select distinct c from p) x),
sp as (select draw, {H("'two-way|scenario|' || draw || '|' || k")} % n as k from sn, range(1, 61) as r(draw)), cp as (select draw, {H("'two-way|coordinate|' || draw || '|' || k")} % n as k from cn, range(1, 61) as r(draw)),
m as (select model, draw, avg(v) as m from sp join sn using (k) join cp using (draw) join cn on cp.k = cn.k join p on p.s = sn.s and p.c = cn.c group by all)"""

QUERIES = {
    "cls_auroc": (auroc, f"with {CURVE_SQL} select source, round(sum(n * (tp - p / 2.0::double)) / (max(pp) * max(nn)), 6) as auroc from k group by source"),
    "cls_auprc": (auprc, f"with {CURVE_SQL} select source, round(sum(p / pp * tp / (tp + fp)), 6) as auprc from k group by source"),
    "cls_best_f1": (best_f1, f"with {THRESH_SQL(100)}, f as (select *, case when tp > 0 then 2.0::double * tp / (tp + fp + pp) else 0 end as f1 from t) select source, round(max(f1), 6) as f1, arg_max(threshold, (f1, -k)) as threshold from f group by source"),
    "cls_threshold_for_recall": (recall_threshold, f"with {THRESH_SQL(1000)} select source, coalesce(max(threshold) filter (tp / pp >= 0.9), arg_max(threshold, (tp, threshold))) as threshold from t group by source"),
    "cls_ece": (ece, f"with {PRED_SQL}, b as (select source, least(floor(score * 10), 9) as bin, count(*) as n, avg(score) as conf, avg(label::double) as acc from pred group by all) select source, round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from b group by source"),
    "cls_confusion": (
        confusion,
        f"""with {PRED_SQL}, c as (select source, count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, count(*) filter (score < 0.5 and label = 1) as fn, count(*) filter (score < 0.5 and label = 0) as tn from pred group by source)
        select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from c""",
    ),
    "agg_source_macro": (macro_gap, f"with {PRED_SQL}, c as (select source, avg(((score >= 0.5)::int = label)::int) as a, count(*) filter (score >= 0.5 and label = 1) / count(*) filter (label = 1) as r from pred group by source) select round(avg(a), 6) as macro, round(max(a) - min(a), 6) as gap, round(min(r), 6) as worst_recall from c"),
    "agg_bins": (dt_bins, f"with {PRED_SQL} select case when score < 0.1 then 0 when score < 0.3 then 1 when score < 0.6 then 2 else 3 end as bin, count(*) as n, round(avg(label::double), 6) as rate from pred where score <= 0.999 group by 1"),
    "cls_prefix_buckets": (
        prefix_buckets,
        f"""with {PRED_SQL}, k as (select *, event_id % 9 + 1 as k from pred), b as (select *, case when k between 2 and 5 then 'k' || k when k >= 6 then 'k6plus' end as bucket from k union all select *, 'terminal' from k)
        select bucket, count(*) as n, round(avg((label = (score >= 0.5)::int)::int), 6) as accuracy from b where bucket is not null group by bucket""",
    ),
    "ret_tie_ranks": (tie_ranks, f"with {RANK_SQL} select gallery, above, tied, size, {', '.join(f'round({REC(k)}, 6) as recall_at_{k}' for k in (1, 5, 10))}, round({RR}, 6) as mrr from r"),
    "agg_scopes": (gallery_scopes, f"with {RANK_SQL}, e as (select gallery % 4 as source, {REC(5)} as r5, {RR} as rr, size from r) select coalesce(e.source, -1)::bigint as source, grouping(e.source)::int as overall, count(*) as n, round(avg(r5), 6) as recall_at_5, round(avg(rr), 6) as mrr, min(size) as least, max(size) as most from e group by cube (e.source)"),
    "agg_log_weighted": (log_weighted, f"with {RANK_SQL}, e as (select gallery % 4 as source, {RR} as rr, log10(size) as w from r) select source, round(sum(w * rr) / sum(w), 6) as macro from e group by source"),
    "ret_embedding_metrics": (
        retrieval,
        """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select q.vec_id as q, e.vec_id, e.label = q.label as hit, round(list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])), 9) as sim from e, e q where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id),
        r as (select *, row_number() over w as rank, sum(hit::int) over (partition by q order by sim desc, vec_id rows unbounded preceding) as hits from s window w as (partition by q order by sim desc, vec_id))
        select q, min(rank)::int as first, (min(rank) <= 5)::int as recall_at_5, round(1.0::double / min(rank), 6) as rr, round(avg(hits / rank), 6) as ap from r where hit group by q""",
    ),
    "win_spearman": (
        spearman,
        """with o as (select o_orderstatus, round(o_totalprice, -3) as x, o_custkey % 50 as y from orders), r as (select o_orderstatus, rank() over (partition by o_orderstatus order by x) + (count(*) over (partition by o_orderstatus, x) - 1) / 2.0 as rx, rank() over (partition by o_orderstatus order by y) + (count(*) over (partition by o_orderstatus, y) - 1) / 2.0 as ry from o)
        select o_orderstatus, round(corr(rx, ry), 6) as rho from r group by o_orderstatus""",
    ),
    "win_holm": (
        holm,
        """with a as (select s_nationkey, s_suppkey, s_suppkey * 37 % 100 / 1000.0::double as p from supplier), r as (select *, least(1.0, (count(*) over (partition by s_nationkey) - row_number() over (partition by s_nationkey order by p, s_suppkey) + 1) * p) as raw from a)
        select s_nationkey, s_suppkey, round(max(raw) over (partition by s_nationkey order by p, s_suppkey rows unbounded preceding), 6) as p_holm from r""",
    ),
    "win_equal_count_bins": (equal_count_bins, "with b as (select *, ntile(7) over (partition by o_orderstatus order by o_totalprice, o_orderkey)::int as bin from orders) select o_orderstatus, bin, count(*) as n, round(avg(o_totalprice), 4) as mean from b group by all"),
    "win_quartiles": (quartiles, "with q as (select o_orderstatus, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders group by 1) select o_orderstatus, case when o_totalprice >= q[3] then 'q4' when o_totalprice >= q[2] then 'q3' when o_totalprice >= q[1] then 'q2' else 'q1' end as quartile, count(*) as n from orders join q using (o_orderstatus) group by all"),
    "stat_robust_scale": (robust, "with q as (select p_brand, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) as q, stddev_pop(p_retailprice) as sd from part group by 1) select p_partkey, round((p_retailprice - q[2]) / case when q[3] > q[1] then (q[3] - q[1]) / 1.349 when sd > 0 then sd else 1 end, 5) as z from part join q using (p_brand)"),
    "stat_trimmed_mean": (trimmed, "with r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice) as r, count(*) over (partition by o_orderpriority) as n from orders) select o_orderpriority, round(avg(o_totalprice), 4) as trimmed from r where r > floor(n * 0.05) and r <= n - floor(n * 0.05) group by 1"),
    "stat_bootstrap": (
        boot,
        f"""with c as (select c_mktsegment as s, c_acctbal as v, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as k, count(*) over (partition by c_mktsegment) as n from customer),
        p as (select s, draw, {H("'boot|' || s || '|' || draw || '|' || k")} % n as k from c, range(1, 101) as r(draw)), m as (select s, draw, avg(v) as m from p join c using (s, k) group by all), b as (select draw, avg(m) as macro from m group by 1),
        o as (select avg(m) as mean from (select avg(v) as m from c group by s) x)
        select round(quantile_cont(macro, 0.025), 4) as lo, round(quantile_cont(macro, 0.975), 4) as hi, round(any_value(mean), 4) as mean from b, o""",
    ),
    "stat_sign_flip_macro": (
        flips_macro,
        f"""with s as (select s_nationkey, s_suppkey, s_acctbal - 4500 as v from supplier), o as (select avg(m) as observed from (select avg(v) as m from s group by s_nationkey) x),
        m as (select draw, avg(m) as m from (select s_nationkey, draw, avg(case when {H("'flip|' || s_nationkey || '|' || s_suppkey || '|' || draw")} % 2 = 0 then v else -v end) as m from s, range(1, 61) as r(draw) group by all) y group by draw)
        select round(observed, 4) as observed, round((1 + count(*) filter (m >= observed - 1e-12)) / 61.0::double, 6) as p from m, o group by observed""",
    ),
    "stat_group_summary": (
        group_summary,
        """with g as (select l_returnflag, l_suppkey, avg(l_discount - l_tax) as m from lineitem group by all) select l_returnflag, round(quantile_cont(m, 0.5), 8) as median, round(count(*) filter (m > 0) / count(*), 6) as positive, count(*) as groups from g group by 1""",
    ),
    "stat_mad_scale": (
        mad,
        """with x as (select p_brand, p_retailprice as x from part where p_partkey % 13 <> 0), c as (select p_brand, quantile_cont(x, 0.5) as c, stddev_pop(x) as sd from x group by 1), s as (select p_brand, any_value(c) as c, any_value(sd) as sd, 1.4826 * quantile_cont(abs(x - c), 0.5) as mad from x join c using (p_brand) group by 1)
        select p_brand, round(c, 4) as location, round(case when mad > 1e-12 then mad when sd > 1e-12 then sd else 1 end, 5) as scale from s""",
    ),
    "stat_poisson_bootstrap": (
        poisson_boot,
        f"""with u as (select c_mktsegment, c_acctbal, draw, {H("'boot|' || c_custkey || '|' || draw")} / 4294967296.0::double as u from customer, range(1, 41) as r(draw)), w as (select *, {W_POISSON} as w from u),
        m as (select c_mktsegment, draw, sum(w * c_acctbal) / sum(w) as m from w group by all) select c_mktsegment, round(avg(m), 4) as mean, round(quantile_cont(m, 0.025), 4) as q0, round(quantile_cont(m, 0.975), 4) as q1 from m group by 1""",
    ),
    "stat_sign_flip": (
        flips,
        f"""with s as (select s_nationkey, s_suppkey, s_acctbal - 4500 as v from supplier), a as (select s_nationkey, avg(v) as mean from s group by 1), m as (select s_nationkey, draw, avg(case when {H("'flip|' || s_suppkey || '|' || draw")} % 2 = 0 then v else -v end) as m from s, range(1, 51) as r(draw) group by all)
        select s_nationkey, round(mean, 4) as mean, round((count(*) filter (abs(m) >= abs(mean) - 1e-12) + 1) / 51.0, 6) as p from m join a using (s_nationkey) group by s_nationkey, mean""",
    ),
    "stat_two_way_bootstrap": (two_way, f"with {TWO_WAY_SQL} select model, round(quantile_cont(m, 0.025), 7) as lo, round(quantile_cont(m, 0.975), 7) as hi from m group by model"),
    "stat_two_way_deltas": (
        two_way_deltas,
        f"with {TWO_WAY_SQL}, x as (select b.model as baseline, r.m - b.m as delta from m b join m r using (draw) where r.model = 'O' and b.model <> 'O') select baseline, round(quantile_cont(delta, 0.025), 7) as lo, round(quantile_cont(delta, 0.975), 7) as hi, round(count(*) filter (delta > 0) / count(*), 6) as positive from x group by 1",
    ),
}
