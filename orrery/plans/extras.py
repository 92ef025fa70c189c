"""Filters, summaries, distances and selections on the star tables: operators here, their definition in SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C
from ..operators import filters as X
from ..operators import galleries as G
from ..operators import intervals as I
from ..operators import posterior as P
from ..operators import ranking as R
from ..operators import summaries as U
from ..operators import vectors as V
from .tables import load


def weighted_gaussian(spark, d):
    p = load(spark, d, "part").select("p_brand", (F.col("p_size") + 1.0).alias("w"), F.log10("p_retailprice").alias("a"), (F.col("p_size") / 10.0).alias("b"))
    out = P.weighted_moments(p, by=["p_brand"], weight="w", columns=["a", "b"], floor=0.05)
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def bhattacharyya(spark, d):
    p = load(spark, d, "part").select("p_brand", (F.col("p_size") + 1.0).alias("w"), F.log10("p_retailprice").alias("a"), (F.col("p_size") / 10.0).alias("b"))
    m = P.weighted_moments(p, by=["p_brand"], weight="w", columns=["a", "b"], floor=0.05)
    one = lambda s: m.select(F.col("p_brand").alias(f"brand_{s}"), F.array("m_a", "m_b").alias(f"mean_{s}"), F.array("c_a_a", "c_a_b", "c_a_b", "c_b_b").alias(f"cov_{s}"))
    pairs = V.against_all(one("a"), one("b"), query="brand_a", row="brand_b").where("brand_a < brand_b").withColumn("pair", F.concat_ws("|", "brand_a", "brand_b"))
    return P.bhattacharyya(pairs, "pair", 2).select("pair", F.round("score", 5).alias("score"))


def greedy(spark, d):
    """Five pairs of alike parts for each type.  Of parts that are copies the ten of least key are enough: at most eight are used
    and one is the other end, so one of the ten would be taken before any other copy."""
    most, kind = 5, ["p_type", "p_size", "p_retailprice"]
    p = load(spark, d, "part").select(*kind, "p_partkey").where("p_partkey is not null").distinct()
    p = p.withColumn("n", F.row_number().over(Window.partitionBy(*kind).orderBy("p_partkey"))).where(F.col("n") <= 2 * most).drop("n")
    q = p.select("p_type", F.col("p_partkey").alias("j"), F.col("p_size").alias("step"), F.col("p_retailprice").alias("price"))
    steps = p.withColumn("step", F.explode(F.array("p_size", F.col("p_size") - 1, F.col("p_size") + 1)))
    e = I.interval_join(steps, q, lo=F.col("p_retailprice") - 5, hi=F.col("p_retailprice") + 5, at=F.col("price"), width=5, on=["p_type", "step"], dense=True)  # pairs within the calipers only
    e = e.where((F.col("p_partkey") < F.col("j")) & (F.abs(F.col("p_retailprice") - F.col("price")) < 5))
    e = e.select("p_type", F.col("p_partkey").alias("i"), "j", F.round(F.abs(F.col("p_retailprice") - F.col("price")), 4).alias("cost"))
    return P.greedy_disjoint(e, by=["p_type"], most=most)


def matched(spark, d):
    """Small parts of a brand against its large ones within a caliper of price."""
    p = load(spark, d, "part").where("p_size <= 25").select("p_brand", F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("x"))
    q = load(spark, d, "part").where("p_size > 25").select("p_brand", F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("y"))
    return P.matched_on_line(p, q, by=["p_brand"], caliper=60, digits=4)


def shortcut(spark, d):
    from ..operators import metrics as M

    li = load(spark, d, "lineitem").withColumn("label", (F.col("l_quantity") + F.col("l_linenumber") * 3 > 30).cast("int"))
    return M.shortcut_auc(li, ["l_quantity", "l_discount", "l_tax"], "label").select(F.round("auroc", 3).alias("auroc"))


def eligible(spark, d):
    """Candidates in the event's window, at its time, or outside, by price as a time."""
    o = orders(spark, d)
    return o.select(X.mask(F.col("dt"), 5.0).alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def objective(spark, d):
    """Objective of each study's trials: two metrics weighed, the steps that its batches mean, and the best trial first."""
    o = load(spark, d, "orders").groupBy((F.col("o_custkey") % 30).alias("trial")).agg(F.avg("o_totalprice").alias("a"), F.count("*").alias("n"))
    r = U.ranked_trials(o, {"a": 0.7, "n": 0.3}, trial="trial", rows=F.col("n"), batch=64, epochs=3)
    return r.select("trial", F.round("objective", 4).alias("objective"), "steps", "rank")


def latency_rows(spark, d):
    """Each observation's age after its parent's first order, in days, with the parent's nation."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    first = o.groupBy("c_custkey").agg(F.min("o_orderdate").alias("t0"))
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey").join(first, "c_custkey")
    j = o.join(c, "c_custkey")
    return j.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg(F.timestamp_diff("SECOND", F.col("t0"), F.col("o_orderdate")) / 86400.0), 6).alias("latency"))


def density_histogram(spark, d):
    """Histogram of curves by bins of rows and span, from the curves' own rows."""
    li = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.max("l_quantity") - F.min("l_quantity")).alias("span"))
    return li.groupBy(X.bucket(F.col("n"), [1, 3, 5]).alias("rows"), X.bucket(F.col("span"), [5.0, 20.0, 40.0]).alias("spans")).agg(F.count("*").alias("n"))


def bands(spark, d):
    e = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("f"), (F.col("l_discount") * 1000 + 1).alias("e"), F.element_at(F.array(*[F.lit(x) for x in C.M5]), (F.col("l_linenumber") % 6 + 1).cast("int")).alias("m5"))
    b = C.softening(F.col("m5"))
    mag = C.luptitude(F.col("f"), b)
    return e.select("l_orderkey", "l_linenumber", F.round(mag, 5).alias("mag"), F.round(C.luptitude_error(F.col("f"), F.col("e"), b), 7).alias("err"), F.round(C.luptitude_to_flux(mag, b), 2).alias("back"))


def dose_response(spark, d):
    """Five bins of equal count by price over all lines, placed by price buckets of 100."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    r = R.positions(li, bucket=F.floor(F.col("l_extendedprice") / 100), order=["l_extendedprice", "l_orderkey", "l_linenumber"])
    g = r.groupBy(R.ntile(5, F.col("position"), F.col("total")).alias("bin"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("dose"), F.round(F.avg("l_discount"), 6).alias("response"))


def dense_remap(spark, d):
    """Every order's customer as an index without gaps, placed by buckets of 1,000 keys."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    r = R.positions(o, bucket=F.floor(F.col("o_custkey") / 1000), order=["o_custkey"], dense=True)
    return r.select("o_orderkey", F.col("position").cast("int").alias("idx"))


def orders(spark, d):
    return load(spark, d, "orders").withColumn("dt", (F.col("o_totalprice") - 150000.0) / 10000.0)


def calibration(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") / 40.0 + 0.5).alias("s"), (22 + F.col("p_partkey") % 30 / 10.0).alias("m5"), (19 + F.col("p_partkey") % 17 / 10.0).alias("sky"))
    return p.select("p_partkey", *[F.round(c, 6).alias(n) for n, c in X.calibration(F.col("s"), F.col("m5"), F.col("sky")).items()])


def time_shift(spark, d):
    return orders(spark, d).select("o_orderkey", F.round(X.shifted(F.col("dt"), 0.25 * (F.col("o_custkey") % 4), F.abs("dt") < 20), 6).alias("t"))


def reanchor(spark, d):
    o = load(spark, d, "orders").withColumn("own", F.col("o_totalprice") / 2)
    parents = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("to"))
    return X.reanchored(o, parents, key="o_custkey", time="o_totalprice", own="own", other="to").select("o_orderkey", F.round(F.col("t") + 0.00001, 2).alias("t"))


def prefix_exclude(spark, d):
    return X.without_prefix(load(spark, d, "part"), "p_name", "RED").select("p_partkey", "p_name")


def sentinel(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", X.no_sentinel(F.col("o_totalprice") - 1000, high=300000.0).alias("v"))
    return o.where("v is not null")


def broken(spark, d):
    li = load(spark, d, "lineitem")
    bad = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).when(F.col("l_tax") == 0, F.lit(float("inf"))).when(F.col("l_quantity") != 7, F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", bad.alias("x"), "l_tax")


def finite_count(spark, d):
    return X.finite_rows(broken(spark, d), ["x", "l_tax"])[1]


def finite_kept(spark, d):
    return X.finite_rows(broken(spark, d), ["x", "l_tax"])[0].groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"))


def photometry_cleanup(spark, d):
    return X.clean_photometry(load(spark, d, "events"), object_="user_id", key=["user_id", "event_type", "value"], value="value", low=1.0, high=90.0, kind="event_type", mocks=["error"], least=40)


def time_bias(spark, d):
    return orders(spark, d).select("o_orderkey", F.round(X.time_bias(F.col("dt"), weight=0.5, scale=3.0, power=1.5, most=4.0), 6).alias("bias"))


def softmax(spark, d):
    return load(spark, d, "events").select("user_id", "event_id", F.round(X.softmax(F.col("value") / 10, ["user_id"]), 8).alias("p"))


def buckets(spark, d):
    return load(spark, d, "part").select("p_partkey", X.bucket(F.col("p_size"), [2, 3, 4, 6]).alias("det"), X.bucket(F.col("p_retailprice"), [1000.0, 1100.0, 1200.0, 1500.0]).alias("span"))


def mixed_slots(spark, d):
    n = F.col("p_size") + 2
    p = load(spark, d, "part").where("p_size >= 2").select("p_partkey", "p_size", G.allocation(n, 0.3).alias("n_kn"))
    return p.select("p_partkey", "n_kn", (F.col("p_size") + 1 - F.col("n_kn")).alias("n_other"))


def directional_win(spark, d):
    w = X.directional(F.col("l_discount") - F.col("l_tax"), F.col("l_discount") - 0.05)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.round(w["interaction"], 6) + 0.0).alias("interaction"), w["wins"].alias("wins"))


def magnitudes(spark, d):
    jd = F.when(F.col("p_partkey") % 2 == 0, 2460000.5 + F.col("p_partkey")).otherwise(60000.0 + F.col("p_partkey"))
    return load(spark, d, "part").select("p_partkey", F.round(X.flux_of(20 + F.col("p_size") / 10.0), 6).alias("fluxcal"), X.as_mjd(jd).alias("mjd"))


def moments(spark, d):
    li = load(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 6, F.lit(float("nan"))).when(F.col("l_linenumber") < 6, F.col("l_quantity").cast("double")).alias("q"))
    return U.moments(li, "q", by=["l_returnflag"]).select("l_returnflag", "n", "nonfinite", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def latency(spark, d):
    r = U.latency(load(spark, d, "events"), "value", by=["event_type"])
    return r.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p90", "p95", "throughput")], "lo", "hi")


def shortcut_medians(spark, d):
    e = load(spark, d, "events").select((F.col("event_id") % 3 == 0).cast("int").alias("label"), "value", (F.col("event_id") % 100).alias("k"))
    return U.medians(e, ["value", "k"], by=["label"]).select("label", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"), "n")


def worst_source(spark, d):
    r = U.source_score(load(spark, d, "orders"), "o_totalprice", source="o_orderpriority", macro=0.7, gates={"1-URGENT": 100000.0, "5-LOW": 1e9})
    return r.select(F.round("macro", 6).alias("macro"), F.round("worst", 4).alias("worst"), "worst_source", F.round("score", 4).alias("score"), "passed")


def selection_score(spark, d):
    return U.weighted_score(load(spark, d, "orders"), "o_totalprice", group="o_orderstatus", weights={"F": 0.5, "O": 0.3, "P": 0.2}).select(F.round("score", 6).alias("score"))


def positives_per_event(spark, d):
    r = U.rows_a_group(load(spark, d, "orders"), ["o_custkey"])
    return r.select(F.round("median", 4).alias("median"), "lo", "hi", F.round("mean", 6).alias("mean"))


def confusion_rows(spark, d):
    r = U.shares(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return r.select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), "n", F.round("share", 6).alias("share"))


def density(spark, d):
    e = load(spark, d, "events").select((F.col("event_id") % 2).alias("label"), (F.col("event_id") * 7919 % 1000 / F.lit(1000.0)).alias("p"))
    return U.logit_density(e, "p", by=["label"], width=0.5)


def night_coverage(spark, d):
    o = load(spark, d, "orders").select((F.col("o_custkey") % 7).alias("night"), (F.col("o_custkey") % 50).alias("tile"))
    w = load(spark, d, "part").where("p_partkey between 1 and 50").select((F.col("p_partkey") - 1).alias("tile"), "p_size")
    return U.distinct_sum(o, by=["night"], item="tile", weights=w, weight="p_size").select("night", F.col("items").alias("tiles"), F.col("total").alias("p"))


def weighted_bincount(spark, d):
    return U.bin_weights(load(spark, d, "supplier"), "s_nationkey", "s_acctbal").select(F.col("s_nationkey").alias("tile"), F.round("total", 4).alias("p"), "n")


def mixed_outcome(spark, d):
    e = load(spark, d, "events")
    first = F.min("event_id").over(Window.partitionBy("user_id"))
    e = e.select(F.col("user_id").alias("g"), "event_id", F.col("value").alias("s"), (F.col("event_id") == first).alias("pos"), (F.col("event_type") == "view").alias("kn"))
    r = U.mixed_outcome(e, by=["g"], score="s", positive="pos", kin="kn", key="event_id")
    return r.withColumn("margin", F.round("margin", 6))


def out_of_window(spark, d):
    o = orders(spark, d).withColumn("t", X.in_window_or(F.col("dt"), 5.0, 0.1 * (F.col("o_orderkey") % 50)))
    inside = F.abs("dt") <= 5
    return o.agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("replaced"), F.round(F.avg("t"), 6).alias("mean"))


def batch_mean(spark, d):
    r = U.mean_of_batches(load(spark, d, "events"), "value", batch=F.floor(F.col("event_id") / 64))
    return r.select(F.round("batch_mean", 6).alias("batch_mean"), "batches")


def endpoint_table(spark, d):
    li = load(spark, d, "lineitem").withColumn("v", F.col("l_discount") - F.col("l_tax"))
    r = U.endpoints(li, "v", scopes=[["l_returnflag", "l_linestatus"], ["l_returnflag"], []], names=["l_returnflag", "l_linestatus"])
    return r.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "n", F.round("mean", 8).alias("mean"), F.round("positive", 6).alias("positive"), F.round("t", 4).alias("t"), F.round("p_holm", 5).alias("p_holm"))


def width_bucket(spark, d):
    return U.histogram_between(load(spark, d, "orders"), "o_totalprice", 150, low=0.001, high=0.999).withColumnRenamed("bin", "b")


def standardise(spark, d):
    return load(spark, d, "events").select("event_id", F.round(X.standardised(F.col("value"), ["user_id"]), 6).alias("z"))


def harmonic(spark, d):
    return U.harmonic(load(spark, d, "part").select((F.col("p_size") + 1).alias("n")), "n").select("n", F.round("h", 9).alias("h"))


def stable_rank(spark, d):
    e = load(spark, d, "events")
    w = Window.partitionBy("user_id")
    e = e.withColumn("r", F.row_number().over(w.orderBy(F.floor(F.col("value") / 10).desc(), "event_id")))
    return X.first_ranked(e, 1, by=["user_id"], order=["event_id"]).select("user_id", "r")


def pair_mask(spark, d):
    return X.of_large_groups(load(spark, d, "orders"), ["o_custkey"], 12).select("o_orderkey", "o_custkey")


def checkpoint_delta(spark, d):
    s = load(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("step")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return U.kept_checkpoints(s, step="step", value="v", least=50.0)


def forced_positive(spark, d):
    forced = (F.col("event_type") == "purchase") & (F.col("value") > 95)
    return X.first_ranked(load(spark, d, "events"), 6, by=["user_id"], order=[(~forced).cast("int"), F.desc("value"), "event_id"]).select("user_id", "event_id", "slot")


def exhaustive_galleries(spark, d):
    o = X.first_ranked(load(spark, d, "orders"), 3, by=["o_custkey"], order=["o_orderkey"], name="ordinal")
    trial = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return o.withColumn("trial", trial).where(F.floor(F.col("trial") / 2) == F.col("ordinal") - 1).select("o_custkey", "trial", "o_orderkey")


def composite_minimum(spark, d):
    g = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("m"), F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("c"))
    return X.first_ranked(g, 1, by=["o_orderstatus"], order=[(~F.col("c").between(0.4, 0.6)).cast("int"), "m", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "m")


def unique_parent_topk(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("v"))
    return X.first_ranked(g, 3, by=["l_suppkey"], order=[F.desc("v"), "l_partkey"]).select("l_suppkey", "l_partkey", "v")


def band_argmax(spark, d):
    e = load(spark, d, "events")
    return X.best_in_band(e, e, by=["user_id"], value="value", low=20.0, high=20.2)


def shortlist_rescore(spark, d):
    """Ten largest parts of a brand, of these three nearest a price, one a type; others fill up."""
    return X.shortlisted(load(spark, d, "part"), by=["p_brand"], first=[F.desc("p_size"), "p_partkey"], most=10, then=[F.abs(F.col("p_retailprice") - 1200), "p_partkey"], k=3, parent="p_type").select("p_brand", "p_partkey")


def time_mixture(spark, d):
    w = Window.partitionBy("user_id")
    r = F.row_number().over(w.orderBy(F.col("event_id") * 7919 % 10007, "event_id"))
    mode = F.when(r <= F.round(F.count("*").over(w) * 0.25), "empirical").otherwise("uniform")
    return load(spark, d, "events").select("user_id", "event_id", mode.alias("mode"))


def nearest_bin(spark, d):
    wanted, filled = load(spark, d, "part").select(F.col("p_size").alias("q")), load(spark, d, "supplier").select((F.col("s_nationkey") * 2).alias("q"))
    return X.nearest_bin(wanted, filled, bin_="q")


def source_balanced(spark, d):
    return X.first_ranked(load(spark, d, "supplier"), 2, by=["s_nationkey"], order=[F.col("s_suppkey") * 7919 % 1009, "s_suppkey"]).select("s_nationkey", "s_suppkey")


def candidate_dt(spark, d):
    mode = F.element_at(F.array(F.lit("native"), F.lit("zero"), F.lit("positive_shared")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    q = F.col("l_quantity").cast("double")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.candidate_times(mode, q, F.max(q).over(Window.partitionBy("l_orderkey"))).alias("dt"))


def triplets(spark, d):
    """Four kinds of pair under one another, each with its label and the softmax of its user's scores."""
    e = load(spark, d, "events").withColumn("p", X.softmax(F.col("value") / 10, ["user_id"]))
    of = lambda kind: e.where(F.col("event_type") == kind)
    u = X.labelled_union({"true": (of("view"), 1), "mismatch": (of("click"), 0), "foreign": (of("error"), 0), "early": (of("signup"), 0)})
    return u.groupBy("kind", "label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("p"))


def metric_delta(spark, d):
    r = U.deltas(load(spark, d, "orders"), "o_totalprice", by=["o_orderpriority"], model="o_orderstatus", new="F", base="O")
    return r.select(F.col("o_orderpriority").alias("scope"), F.round("delta", 4).alias("delta"))


def event_lattice(spark, d):
    rows = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return U.lattice(load(spark, d, "customer"), rows, key="c_custkey", least=5, failed=F.col("c_acctbal") < 0)


def coverage(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("s"), (F.col("l_suppkey") % 25).alias("c"))
    return U.panel_coverage(li, scenario="s", coordinate="c")


def paired_outcomes(spark, d):
    return X.paired(load(spark, d, "orders"), key=["o_custkey"], of="o_orderstatus", values=["F", "O", "P"])


def probability_range(spark, d):
    from ..operators import contracts as V_

    p = load(spark, d, "lineitem").select((F.col("l_discount") * 10.5).alias("p"))
    return V_.counted(p, {"probability": C.finite(F.col("p")) & F.col("p").between(0, 1)})


def missing_reference(spark, d):
    known = load(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("l_partkey"))
    return U.unreferenced(load(spark, d, "lineitem"), known, key="l_partkey")


def bounds(spark, d):
    return load(spark, d, "lineitem").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


def first_user_turn(spark, d):
    """The first turn that a user takes in each conversation, and how many turns there are."""
    g = load(spark, d, "conversations").groupBy("conv_id")
    return g.agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("turn"), F.count("*").alias("turns"))


DT = "(o_totalprice - 150000.0::double) / 10000"

QUERIES = {
    "phot_luptitude": (
        bands,
        f"""with x as (select l_orderkey, l_linenumber, l_extendedprice as f, l_discount * 1000 + 1 as e, pow(10, 0.4 * (31.4 - [{", ".join(map(str, C.M5))}][l_linenumber % 6 + 1]::double)) / 5 as b from lineitem)
        select l_orderkey, l_linenumber, round(31.4 - 2.5 / ln(10) * (asinh(f / (2 * b)) + ln(b)), 5) as mag, round(2.5 / ln(10) * e / sqrt(f * f + 4 * b * b), 7) as err, round(f, 2) as back from x""",
    ),
    "arr_weighted_gaussian": (
        weighted_gaussian,
        """with p as (select p_brand, p_size + 1.0::double as w, log10(p_retailprice) as a, p_size / 10.0::double as b from part), g as (select p_brand, sum(w) as w, sum(w * w) as w2, sum(w * a) / sum(w) as ma, sum(w * b) / sum(w) as mb, sum(w * a * a) / sum(w) as aa, sum(w * a * b) / sum(w) as ab, sum(w * b * b) / sum(w) as bb from p group by 1)
        select p_brand, round(ma, 6) as m_a, round(mb, 6) as m_b, round((aa - ma * ma) / (1 - w2 / (w * w)) + 0.0025, 6) as c_a_a, round((ab - ma * mb) / (1 - w2 / (w * w)), 6) as c_a_b, round((bb - mb * mb) / (1 - w2 / (w * w)) + 0.0025, 6) as c_b_b from g""",
    ),
    "arr_bhattacharyya": (
        bhattacharyya,
        """with p as (select p_brand, p_size + 1.0::double as w, log10(p_retailprice) as a, p_size / 10.0::double as b from part), g as (select p_brand, sum(w) as w, sum(w * w) as w2, sum(w * a) / sum(w) as ma, sum(w * b) / sum(w) as mb, sum(w * a * a) / sum(w) as aa, sum(w * a * b) / sum(w) as ab, sum(w * b * b) / sum(w) as bb from p group by 1),
        c as (select p_brand, ma, mb, (aa - ma * ma) / (1 - w2 / (w * w)) + 0.0025 as caa, (ab - ma * mb) / (1 - w2 / (w * w)) as cab, (bb - mb * mb) / (1 - w2 / (w * w)) + 0.0025 as cbb from g),
        x as (select l.p_brand || '|' || r.p_brand as pair, l.ma - r.ma as da, l.mb - r.mb as db, (l.caa + r.caa) / 2 as saa, (l.cab + r.cab) / 2 as sab, (l.cbb + r.cbb) / 2 as sbb, l.caa * l.cbb - l.cab * l.cab as dl, r.caa * r.cbb - r.cab * r.cab as dr from c l join c r on l.p_brand < r.p_brand)
        select pair, round(-greatest(0, (da * da * sbb - 2 * da * db * sab + db * db * saa) / (saa * sbb - sab * sab) / 8 + ln((saa * sbb - sab * sab) / sqrt(dl * dr)) / 2), 5) as score from x""",
    ),
    "srt_greedy_disjoint": (greedy, None),
    "srt_least_cost_pairs": (matched, None),
    "stat_shortcut_auc": (shortcut, None),
    "flt_eligibility": (eligible, f"select case when {DT} = 0 then 'at_event' when abs({DT}) <= 5 then 'in_window' else 'outside' end as mask, count(*) as n from orders group by 1"),
    "opx_ranked_trials": (
        objective,
        "with o as (select o_custkey % 30 as trial, avg(o_totalprice) as a, count(*) as n from orders group by 1), s as (select trial, 0.7 * a + 0.3 * n as v, n from o) select trial, round(v, 4) as objective, (3 * ceil(n / 64))::bigint as steps, row_number() over (order by v desc, trial)::int as rank from s",
    ),
    "opx_latency": (
        latency_rows,
        "with f as (select o_custkey, min(o_orderdate) as t0 from orders group by 1) select c_nationkey, count(*) as n, round(avg(epoch(o_orderdate - t0) / 86400), 6) as latency from orders join f using (o_custkey) join customer on c_custkey = o_custkey group by 1",
    ),
    "opx_density_histogram": (
        density_histogram,
        "with c as (select l_orderkey, count(*) as n, max(l_quantity) - min(l_quantity) as s from lineitem group by 1) select (n > 1)::int + (n > 3)::int + (n > 5)::int as rows, (s > 5)::int + (s > 20)::int + (s > 40)::int as spans, count(*) as n from c group by all",
    ),
    "prj_calibration": (
        calibration,
        """with a as (select p_partkey, p_size::double / 40 + 0.5 as s, 22 + (p_partkey % 30)::double / 10 as m5, 19 + (p_partkey % 17)::double / 10 as sky from part), b as (select *, 4 * pi() * pow(s / (2 * sqrt(2 * ln(2))), 2) as area from a), c as (select *, 2 * m5 - sky + 2.5 * log10(25 * area) + 2.5 * log10(1 + pow(10, -0.4 * (m5 - sky)) / area) as zpt from b)
        select p_partkey, round(s / (2 * sqrt(2 * ln(2))) / 0.2, 6) as psf, round(zpt, 6) as zpt, round(sqrt(pow(10, -0.4 * (sky - zpt)) * 0.04), 6) as skysig from c""",
    ),
    "prj_time_shift": (time_shift, f"select o_orderkey, round(case when abs({DT}) < 20 then {DT} + 0.25::double * (o_custkey % 4) else 0 end, 6) as t from orders"),
    "prj_reanchor": (reanchor, "select a.o_orderkey, round(a.o_totalprice + (b.p - a.o_totalprice / 2) + 0.00001::double, 2) as t from orders a join (select o_custkey, avg(o_totalprice) as p from orders group by 1) b on a.o_custkey = b.o_custkey"),
    "flt_prefix_exclude": (prefix_exclude, "select p_partkey, p_name from part where not starts_with(lower(coalesce(p_name, '')), 'red')"),
    "flt_sentinel": (sentinel, "select o_orderkey, o_totalprice - 1000 as v from orders where o_totalprice - 1000 > 0 and o_totalprice - 1000 < 300000"),
    "flt_finite_count": (finite_count, "select count(*) as n, count(*) filter (l_discount <> 0 and l_tax <> 0 and l_quantity <> 7) as usable, count(*) filter (l_discount = 0 or l_tax = 0 or l_quantity = 7) as dropped from lineitem"),
    "flt_finite_rows": (finite_kept, "select l_linenumber, count(*) as n, round(sum(l_discount), 4) as x from lineitem where l_discount <> 0 and l_tax <> 0 and l_quantity <> 7 group by 1"),
    "flt_photometry_cleanup": (photometry_cleanup, "with a as (select distinct user_id, event_type, value from events where value between 1 and 90 and event_type <> 'error') select * from a where user_id in (select user_id from a group by 1 having count(*) >= 40)"),
    "f_time_bias": (time_bias, f"select o_orderkey, round(greatest(-4, -0.5 * pow(abs({DT}) / 3, 1.5)), 6) as bias from orders"),
    "f_softmax": (softmax, "with m as (select user_id, event_id, value / 10 as x, max(value / 10) over (partition by user_id) as m from events) select user_id, event_id, round(exp(x - m) / sum(exp(x - m)) over (partition by user_id), 8) as p from m"),
    "f_buckets": (buckets, "select p_partkey, case when p_size > 6 then 4 when p_size > 4 then 3 when p_size > 3 then 2 when p_size > 2 then 1 else 0 end as det, case when p_retailprice > 1500 then 4 when p_retailprice > 1200 then 3 when p_retailprice > 1100 then 2 when p_retailprice > 1000 then 1 else 0 end as span from part"),
    "f_mixed_slots": (mixed_slots, "with a as (select p_partkey, p_size, least(greatest(floor((p_size + 1) * 0.3 + 0.5), 1), p_size)::int as n_kn from part where p_size >= 2) select p_partkey, n_kn, p_size + 1 - n_kn as n_other from a"),
    "f_directional_win": (directional_win, "with a as (select l_orderkey, l_linenumber, l_discount - l_tax as a, l_discount - 0.05::double as b from lineitem) select l_orderkey, l_linenumber, round(0.5::double * (a + b), 6) + 0.0 as interaction, 0.5::double * (case when a > 0 then 1 when a < 0 then 0 else 0.5::double end + case when b > 0 then 1 when b < 0 then 0 else 0.5::double end) as wins from a"),
    "f_magnitude_to_flux": (magnitudes, "select p_partkey, round(pow(10, -0.4::double * (20 + p_size::double / 10 - 27.5)), 6) as fluxcal, case when p_partkey % 2 = 0 then 2460000.5::double + p_partkey - 2400000.5 else 60000.0::double + p_partkey end as mjd from part"),
    "agg_moments": (moments, "with x as (select l_returnflag as f, l_linenumber < 6 as ok, l_quantity::double as q from lineitem) select f as l_returnflag, count(*) filter (ok) as n, count(*) filter (not ok) as nonfinite, round(avg(q) filter (ok), 6) as mean, round(stddev_pop(q) filter (ok), 6) as std from x group by 1"),
    "agg_latency": (latency, "select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, min(value) as lo, max(value) as hi, round(count(*) / sum(value), 6) as throughput from events group by 1"),
    "agg_shortcut_medians": (shortcut_medians, "select case when event_id % 3 = 0 then 1 else 0 end as label, round(quantile_cont(value, 0.5), 6) as value, round(quantile_cont(event_id % 100, 0.5), 6) as k, count(*) as n from events group by 1"),
    "agg_worst_source": (worst_source, "with s as (select o_orderpriority as s, avg(o_totalprice) as m from orders group by 1) select round(avg(m), 6) as macro, round(min(m), 4) as worst, arg_min(s, (m, s)) as worst_source, round(0.7 * avg(m) + 0.3 * min(m), 4) as score, coalesce(min(m) filter (s = '1-URGENT') >= 100000, false) and coalesce(min(m) filter (s = '5-LOW') >= 1e9, false) as passed from s"),
    "agg_selection_score": (selection_score, "with a as (select case o_orderstatus when 'F' then 0.5 when 'O' then 0.3 else 0.2 end::double as w, avg(o_totalprice) as m from orders group by o_orderstatus) select round(sum(w * m) / sum(w), 6) as score from a"),
    "agg_positives_per_event": (positives_per_event, "with a as (select count(*) as n from orders group by o_custkey) select round(quantile_cont(n, 0.5), 4) as median, min(n) as lo, max(n) as hi, round(avg(n), 6) as mean from a"),
    "agg_confusion_rows": (confusion_rows, "with x as (select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by all) select a, b, n, round(n / (select sum(n) from x y where y.a = x.a), 6) as share from x"),
    "agg_density": (density, "with a as (select event_id % 2 as label, least(greatest(event_id * 7919 % 1000 / 1000.0::double, 0.001), 0.999) as p from events) select label, floor(ln(p / (1 - p)) * 2)::int as bin, count(*) as n from a group by all"),
    "agg_dose_response": (dose_response, "with a as (select l_extendedprice as x, l_discount as y, ntile(5) over (order by l_extendedprice, l_orderkey, l_linenumber)::int as bin from lineitem) select bin, count(*) as n, round(avg(x), 4) as dose, round(avg(y), 6) as response from a group by 1"),
    "agg_night_coverage": (night_coverage, "select night, count(*) as tiles, sum(p_size)::bigint as p from (select distinct o_custkey % 7 as night, o_custkey % 50 as tile from orders) a join part on tile + 1 = p_partkey group by 1"),
    "agg_weighted_bincount": (weighted_bincount, "select s_nationkey as tile, round(sum(s_acctbal), 4) as p, count(*) as n from supplier group by 1"),
    "agg_mixed_outcome": (
        mixed_outcome,
        """with a as (select user_id as g, event_id as id, event_id = min(event_id) over (partition by user_id) as pos, event_type = 'view' as kn, value as s from events), p as (select g, s as ps from a where pos)
        select g, count(*) filter (not pos and s > ps) + 1 as rank_all, count(*) filter (not pos and kn and s > ps) + 1 as rank_kin, count(*) filter (not pos and not kn and s > ps) + 1 as rank_other, round(any_value(ps) - max(s) filter (not pos), 6) as margin, arg_max(case when pos then 'positive' when kn then 'kin' else 'other' end, (s, id)) as top from a join p using (g) group by g""",
    ),
    "agg_out_of_window": (out_of_window, f"with a as (select o_orderkey, {DT} as dt from orders) select count(*) as n, count(*) filter (abs(dt) <= 5) as inside, count(*) filter (abs(dt) > 5) as replaced, round(avg(case when abs(dt) <= 5 then dt else 0.1 * (o_orderkey % 50) end), 6) as mean from a"),
    "agg_batch_mean": (batch_mean, "with a as (select event_id // 64 as b, avg(value) as m from events group by 1) select round(avg(m), 6) as batch_mean, count(*) as batches from a"),
    "agg_endpoint_table": (
        endpoint_table,
        """with x as (select l_returnflag as f, l_linestatus as s, l_discount - l_tax as v from lineitem), e as (select f as flag, s as status, v from x union all select f, 'all', v from x union all select 'all', 'all', v from x),
        g as (select flag, status, count(*) as n, avg(v) as mean, count(*) filter (v > 0) / count(*) as positive, avg(v) / (stddev_samp(v) / sqrt(count(*))) as t from e group by all), k as (select *, abs(t) / sqrt(2) as z, 1 / (1 + 0.3275911 * abs(t) / sqrt(2)) as k from g),
        p as (select *, (0.254829592 * k - 0.284496736 * k * k + 1.421413741 * pow(k, 3) - 1.453152027 * pow(k, 4) + 1.061405429 * pow(k, 5)) * exp(-z * z) as p from k), r as (select *, least(1.0, (count(*) over () - row_number() over (order by p, flag, status) + 1) * p) as raw from p)
        select flag, status, n, round(mean, 8) as mean, round(positive, 6) as positive, round(t, 4) as t, round(max(raw) over (order by p, flag, status rows unbounded preceding), 5) as p_holm from r""",
    ),
    "stat_width_bucket": (width_bucket, "with q as (select quantile_cont(o_totalprice, 0.001) as lo, quantile_cont(o_totalprice, 0.999) as hi from orders) select least(149, floor((o_totalprice - lo) / (hi - lo) * 150))::int as b, count(*) as n from orders, q where o_totalprice between lo and hi group by 1"),
    "win_standardise": (standardise, "with g as (select user_id, avg(value) as m, stddev_pop(value) as s from events group by 1) select event_id, round(case when s > 0 then (value - m) / s else 0 end, 6) as z from events join g using (user_id)"),
    "win_harmonic": (harmonic, "with n as (select distinct p_size + 1 as n from part) select n, round(list_sum(list_transform(range(1, n + 1), lambda k: 1.0::double / k)), 9) as h from n"),
    "win_stable_rank": (stable_rank, "with a as (select user_id, event_id, row_number() over (partition by user_id order by floor(value / 10) desc, event_id)::int as r from events) select user_id, r from a where (user_id, event_id) in (select user_id, min(event_id) from events group by 1)"),
    "win_pair_mask": (pair_mask, "select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) >= 12)"),
    "win_dense_remap": (dense_remap, "select o_orderkey, (dense_rank() over (order by o_custkey) - 1)::int as idx from orders"),
    "win_checkpoint_delta": (checkpoint_delta, "with s as (select o_custkey % 40 as step, round(avg(o_totalprice), 2) as v from orders group by 1) select step, v, coalesce(v > (select max(v) from s b where b.step < a.step) + 50, true) as keep from s a"),
    "srt_forced_positive": (forced_positive, "with a as (select user_id, event_id, row_number() over (partition by user_id order by case when event_type = 'purchase' and value > 95 then 0 else 1 end, value desc, event_id)::int as slot from events) select * from a where slot <= 6"),
    "srt_exhaustive_galleries": (exhaustive_galleries, "with a as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k from orders) select o_custkey, trial::int as trial, o_orderkey from a, range(0, 5) as t(trial) where k = trial // 2"),
    "srt_composite_minimum": (composite_minimum, "with a as (select o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) as m, count(*) filter (o_totalprice > 150000) / count(*) as c from orders group by all) select o_orderstatus, arg_min(o_orderpriority, (not c between 0.4 and 0.6, m, o_orderpriority)) as o_orderpriority, arg_min(m, (not c between 0.4 and 0.6, m, o_orderpriority)) as m from a group by 1"),
    "srt_unique_parent_topk": (unique_parent_topk, "with a as (select l_suppkey, l_partkey, max(l_extendedprice) as v from lineitem group by all), b as (select *, row_number() over (partition by l_suppkey order by v desc, l_partkey) as r from a) select l_suppkey, l_partkey, v from b where r <= 3"),
    "srt_band_argmax": (
        band_argmax,
        """with g as (select user_id, max(value) filter (value between 20 and 20.2) as a, max(value) filter (value < 20) as b, min(value) filter (value > 20.2) as c from events group by 1)
        select user_id, coalesce(a, b, c) as pick, case when a is not null then 0 when b is not null then 1 when c is not null then 2 else 3 end as level from g""",
    ),
    "srt_shortlist_rescore": (
        shortlist_rescore,
        """with a as (select *, row_number() over (partition by p_brand order by p_size desc, p_partkey) > 10 as late, abs(p_retailprice - 1200) as x from part), b as (select p_brand, p_type, min((late, x, p_partkey)) as k from a group by all), c as (select p_brand, k.c as p_partkey, row_number() over (partition by p_brand order by k) as r from (select p_brand, {'a': k[1], 'b': k[2], 'c': k[3]} as k from b) y)
        select p_brand, p_partkey from c where r <= 3""",
    ),
    "smp_time_mixture": (time_mixture, "select user_id, event_id, case when row_number() over (partition by user_id order by event_id * 7919 % 10007, event_id) <= round(count(*) over (partition by user_id) * 0.25) then 'empirical' else 'uniform' end as mode from events"),
    "smp_nearest_bin": (nearest_bin, "select q, arg_min(b, (abs(b - q), b)) as bin from (select distinct p_size as q from part) a, (select distinct s_nationkey * 2 as b from supplier) c group by q"),
    "smp_source_balanced": (source_balanced, "with a as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey * 7919 % 1009, s_suppkey) as r from supplier) select s_nationkey, s_suppkey from a where r <= 2"),
    "opx_candidate_dt": (candidate_dt, "select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then l_quantity when 1 then 0 else max(l_quantity) over (partition by l_orderkey) end::double as dt from lineitem"),
    "opx_triplets": (
        triplets,
        """with m as (select user_id, event_type, exp(value / 10 - max(value / 10) over (partition by user_id)) as e from events), p as (select event_type, e / sum(e) over (partition by user_id) as p from m)
        select case event_type when 'view' then 'true' when 'click' then 'mismatch' when 'error' then 'foreign' else 'early' end as kind, case when event_type = 'view' then 1 else 0 end as label, count(*) as n, round(avg(p), 8) as p from p where event_type in ('view', 'click', 'error', 'signup') group by event_type""",
    ),
    "opx_metric_delta": (metric_delta, "select a.o_orderpriority as scope, round(a.m - b.m, 4) as delta from (select o_orderpriority, avg(o_totalprice) as m from orders where o_orderstatus = 'F' group by 1) a join (select o_orderpriority, avg(o_totalprice) as m from orders where o_orderstatus = 'O' group by 1) b using (o_orderpriority)"),
    "opx_event_lattice": (event_lattice, "select c_custkey, case when c_acctbal < 0 then 'type1' when (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') >= 5 then 'pos' else 'type2' end as kind from customer"),
    "opx_coverage": (coverage, "select l_returnflag as s, count(distinct l_suppkey % 25) as coordinates, count(*) as n, count(distinct l_suppkey % 25) = (select count(distinct l_suppkey % 25) from lineitem) as complete from lineitem group by 1"),
    "val_paired_outcomes": (paired_outcomes, "select o_custkey, 3 - count(distinct o_orderstatus) as missing from orders group by 1 having count(distinct o_orderstatus) < 3"),
    "val_probability_range": (probability_range, "select 'probability' as rule, count(*) filter (l_discount * 10.5 < 0 or l_discount * 10.5 > 1) as n from lineitem"),
    "val_missing_reference": (missing_reference, "select l_partkey, count(*) as n from lineitem l where not exists (select 1 from part p where p.p_partkey = l.l_partkey and p.p_size < 45) group by 1"),
    "src_bounds": (bounds, "select min(l_shipdate) as first, max(l_shipdate) as last from lineitem"),
    "src_first_user_turn": (first_user_turn, "select conv_id, min(turn) filter (role = 'user') as turn, count(*) as turns from conversations group by 1"),
}
