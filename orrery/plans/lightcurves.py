"""Light-curve queries over ``events`` as photometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C
from ..operators import lightcurve as L
from .tables import OBS_SQL, PARENT_SQL, load, observations, parents

DET = "flux / error > 5"
CLUSTERS_SQL = f"""{OBS_SQL}, gap as (select *, coalesce((t_us - lag(t_us) over (partition by object, band order by t_us) > 7200000000)::int, 0) as begins from obs),
cl as (select *, sum(begins) over (partition by object, band order by t_us rows unbounded preceding)::int as cluster, 1 / (error * error) as w from gap),
cl0 as (select *, min(t_us) over (partition by object, band, cluster) as t0 from cl),
merged as (select object, band, cluster, min(t0) + sum(w * (t_us - t0)) / sum(w) as t_us, sum(w * flux) / sum(w) as flux, 1 / sqrt(sum(w)) as error, count(*) as merged from cl0 group by all)"""

#: The kinds of event, in the role of bands.
BANDS = ["click", "error", "purchase", "signup", "view"]


def clusters(spark, d):
    return L.with_clusters(L.usable(observations(spark, d))).select("seq", "object", "band", "cluster")


def merged(spark, d):
    out = L.merge(observations(spark, d))
    return out.select("object", "band", "cluster", F.round(F.col("t_us") / 8.64e10, 6).alias("mjd"), F.round("flux", 6).alias("flux"), F.round("error", 6).alias("error"), "merged")


def first_detection(spark, d):
    obs = observations(spark, d).withColumn("bits", F.when(F.col("flag") == 0, 4096).otherwise(1))
    head = F.when(F.col("object") % 2 == 0, F.lit(60000.0)).otherwise(F.lit(1e6))
    return L.first_detection(obs, fallback=head, flag=F.col("bits"), threshold=15.0)


def delay_distribution(spark, d):
    """Merge within two hours, find first detections, and describe their delay after the first observation by source."""
    m = L.merge(observations(spark, d)).withColumn("seq", F.col("t_us"))
    starts = m.groupBy("object").agg(F.min("t_us").alias("start_us"))
    delay = L.first_detection(m).join(starts, "object").join(parents(spark, d), "object").where("first_us is not null").withColumn("delay", (F.col("first_us") - F.col("start_us")) / F.lit(8.64e10))
    q = F.percentile("delay", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = delay.groupBy("source").agg(F.count("*").alias("n"), F.avg("delay").alias("mean"), F.stddev_pop("delay").alias("std"), q.alias("q"), F.min("delay").alias("lo"), F.max("delay").alias("hi"))
    return out.select("source", "n", *[F.round(c, 6).alias(n) for c, n in ((F.col("mean"), "mean"), (F.col("std"), "std"), (F.col("q")[0], "q25"), (F.col("q")[1], "q50"), (F.col("q")[2], "q75"), (F.col("lo"), "lo"), (F.col("hi"), "hi"))])


def curve_meta(spark, d):
    return L.meta(observations(spark, d)).withColumn("t_span", F.round("t_span", 6))


def regime(spark, d):
    m = L.meta(observations(spark, d))
    return m.where("n_det >= 2 and n_bands >= 2 and t_span > 3.0").select("object", "n_det", "n_bands")


def relaxed(spark, d):
    """The time-span predicate is dropped if it leaves fewer than half of the rows."""
    m = L.meta(observations(spark, d)).where("n_det >= 1")
    total, strict = m.agg(F.count("*"), F.count_if(F.col("t_span") > 25)).first()
    return (m.where("t_span > 25") if strict * 2 >= total else m).select("object", "n_obs")


def crop(spark, d):
    obs = observations(spark, d)
    zero = obs.groupBy("object").agg(F.min("t_us").alias("zero_us"))
    return L.crop(obs, zero, before_days=0.5, after_days=10.0).select("seq", "object", F.round((F.col("t_us") - F.col("zero_us")) / 8.64e10, 6).alias("rel_days"))


def prefix(spark, d):
    return L.prefix(observations(spark, d), 2).select("seq", "object", F.col("n_det").cast("long").alias("n_det"))


def truncate(spark, d):
    obs = observations(spark, d)
    zero = obs.groupBy("object").agg(F.max("t_us").alias("zero_us"))
    return L.truncate(obs.join(zero, "object").withColumn("rel_us", F.col("t_us") - F.col("zero_us")), 3).select("object", "seq", "rel_us")


def manifest(spark, d):
    return L.prefix_manifest(observations(spark, d), [1, 2, 3, 5])


def dense(spark, d):
    """Every band there and back: what comes back is the whole light curve."""
    wide = L.densify(observations(spark, d), BANDS)
    return L.undensify(wide, BANDS).select("object", "slot", F.col("band"), F.round("flux", 6).alias("flux"))


def luminance(spark, d):
    b = C.softening(F.lit(24.7))
    obs = observations(spark, d).withColumn("mag", C.luptitude(F.col("flux") * F.lit(C.FLUX_FACTOR), b)).withColumn("err", C.luptitude_error(F.col("flux") * F.lit(C.FLUX_FACTOR), F.col("error") * F.lit(C.FLUX_FACTOR), b))
    return obs.groupBy("object").agg(F.round(F.avg("mag"), 5).alias("mean"), F.round(F.stddev_pop("mag"), 5).alias("std"), F.round(F.max("mag") - F.min("mag"), 5).alias("amplitude"), F.round(F.avg("err"), 5).alias("mean_err"))


def drop_reasons(spark, d):
    m = L.meta(observations(spark, d))
    reason = F.when(F.col("n_obs") < 5, "too_few").when(F.col("n_det") == 0, "no_detection").when(F.col("n_bands") < 2, "one_band").otherwise("kept")
    return m.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def sampling_features(spark, d):
    m = L.meta(observations(spark, d))
    return m.select("object", F.round(F.log1p("n_obs"), 6).alias("log_n"), F.round(F.col("n_bands") / 6.0, 6).alias("band_fraction"), F.round(F.log1p("t_span"), 6).alias("log_span"))


def joint_histogram(spark, d):
    m = L.meta(observations(spark, d))
    det = F.when(F.col("n_det") > 10, 2).when(F.col("n_det") > 3, 1).otherwise(0)
    span = F.least(F.floor(F.col("t_span") / 10), F.lit(3)).cast("int")
    return m.groupBy(det.alias("det_bin"), F.col("n_bands").alias("band_bin"), span.alias("span_bin")).agg(F.count("*").alias("n"))


def islands(spark, d):
    """Runs of consecutive days with activity of each user: first two runs of two days or more."""
    days = observations(spark, d).select("object", F.floor(F.col("t_us") / F.lit(86_400_000_000)).cast("long").alias("day")).distinct()
    order = Window.partitionBy("object").orderBy("day")
    runs = days.withColumn("run", F.col("day") - F.row_number().over(order)).groupBy("object", "run").agg(F.min("day").alias("first"), F.max("day").alias("last")).where("last > first")
    return runs.withColumn("n", F.row_number().over(Window.partitionBy("object").orderBy("first"))).where("n <= 2").select("object", "n", "first", "last")


def per_band_features(spark, d):
    """Per band: number, weighted mean and peak flux, with an availability mask; a colour of two bands."""
    obs = observations(spark, d)
    w = F.lit(1.0) / (F.col("error") * F.col("error"))
    f = obs.groupBy("object").pivot("band", ["click", "purchase", "view"]).agg(F.count(F.lit(1)).alias("n"), (F.sum(w * F.col("flux")) / F.sum(w)).alias("mean"), F.max("flux").alias("peak"))
    cols = [F.coalesce(F.col(f"{b}_n"), F.lit(0)).cast("long").alias(f"{b}_n") for b in ("click", "purchase", "view")]
    means = [F.round(f"{b}_{s}", 6).alias(f"{b}_{s}") for b in ("click", "purchase", "view") for s in ("mean", "peak")]
    return f.select("object", *cols, *means, F.round(F.col("click_mean") - F.col("view_mean"), 6).alias("colour"))


META_SQL = f"""{OBS_SQL}, m as (select object, count(*) as n_obs, count(*) filter ({DET}) as n_det, count(distinct band) as n_bands, (max(t_us) - min(t_us)) / 8.64e10 as t_span, case when count(distinct band) = 1 then min(band) end as single_band from obs group by object)"""
B_SOFT = "(pow(10, 0.4 * (31.4 - 24.7)) / 5)"
POG = "(2.5 / ln(10))"

QUERIES = {
    "lc_clusters": (clusters, f"with {CLUSTERS_SQL} select seq, object, band, cluster from cl"),
    "lc_merge": (merged, f"with {CLUSTERS_SQL} select object, band, cluster, round(t_us / 8.64e10, 6) as mjd, round(flux, 6) as flux, round(error, 6) as error, merged from merged"),
    "lc_first_detection": (
        first_detection,
        f"""with {OBS_SQL}, a as (select object, min_by(t_us, case when flux / error > 15 then seq end) as by_snr, min_by(t_us, case when flag = 0 then seq end) as by_flag from obs group by object)
        select object, coalesce(by_snr, by_flag, case when object % 2 = 0 then (60000.0 * 8.64e10)::bigint end) as first_us from a""",
    ),
    "lc_delay_distribution": (
        delay_distribution,
        f"""with {CLUSTERS_SQL}, {PARENT_SQL}, s as (select object, min(t_us) as start_us, min(t_us) filter ({DET}) as first_us from merged group by object),
        dl as (select source, (first_us - start_us) / 8.64e10 as delay from s join parent using (object) where first_us is not null)
        select source, count(*) as n, round(avg(delay), 6) as mean, round(stddev_pop(delay), 6) as std, round(quantile_cont(delay, 0.25), 6) as q25, round(quantile_cont(delay, 0.5), 6) as q50, round(quantile_cont(delay, 0.75), 6) as q75,
        round(min(delay), 6) as lo, round(max(delay), 6) as hi from dl group by source""",
    ),
    "lc_meta": (curve_meta, f"with {META_SQL} select object, n_obs, n_det, n_bands, round(t_span, 6) as t_span, single_band from m"),
    "lc_regime_filter": (regime, f"with {META_SQL} select object, n_det, n_bands from m where n_det >= 2 and n_bands >= 2 and t_span > 3.0"),
    "lc_relaxed_filter": (relaxed, f"with {META_SQL}, k as (select * from m where n_det >= 1), c as (select count(*) filter (t_span > 25) * 2 >= count(*) as strict from k) select object, n_obs from k, c where not strict or t_span > 25"),
    "lc_window_crop": (crop, f"with {OBS_SQL}, z as (select *, min(t_us) over (partition by object) as zero_us from obs) select seq, object, round((t_us - zero_us) / 8.64e10, 6) as rel_days from z where t_us between zero_us - 0.5 * 8.64e10 and zero_us + 10 * 8.64e10"),
    "lc_prefix": (
        prefix,
        f"""with {OBS_SQL}, n as (select *, sum(({DET})::int) over (partition by object order by t_us, seq rows unbounded preceding)::bigint as n_det from obs), c as (select *, min(case when n_det >= 2 then t_us end) over (partition by object) as cut from n)
        select seq, object, n_det from c where cut is null or t_us <= cut""",
    ),
    "lc_truncate": (truncate, f"with {OBS_SQL}, z as (select *, t_us - max(t_us) over (partition by object) as rel_us from obs), r as (select *, row_number() over (partition by object order by abs(rel_us), seq) as n from z) select object, seq, rel_us from r where n <= 3"),
    "lc_prefix_manifest": (
        manifest,
        f"""with {OBS_SQL}, n as (select object, count(*) filter ({DET})::int as n_det from obs group by object having count(*) filter ({DET}) > 0)
        select distinct object, n_det, k from (select object, n_det, unnest([1, 2, 3, 5]) as k from n) where k <= n_det union select object, n_det, n_det from n""",
    ),
    "lc_dense_roundtrip": (
        dense,
        f"""with {OBS_SQL}, s as (select object, t_us, row_number() over (partition by object order by t_us)::int - 1 as slot from (select distinct object, t_us from obs))
        select object, slot, band, round(max(flux), 6) as flux from obs join s using (object, t_us) group by all""",
    ),
    "phot_luminance": (
        luminance,
        f"""with {OBS_SQL}, f as (select object, flux * pow(10, 0.4 * 3.9) as f, error * pow(10, 0.4 * 3.9) as e, {B_SOFT} as b from obs), g as (select object, 31.4 - {POG} * (asinh(f / (2 * b)) + ln(b)) as mag, {POG} * e / sqrt(f * f + 4 * b * b) as err from f)
        select object, round(avg(mag), 5) as mean, round(stddev_pop(mag), 5) as std, round(max(mag) - min(mag), 5) as amplitude, round(avg(err), 5) as mean_err from g group by object""",
    ),
    "lc_drop_reasons": (drop_reasons, f"with {META_SQL} select case when n_obs < 5 then 'too_few' when n_det = 0 then 'no_detection' when n_bands < 2 then 'one_band' else 'kept' end as reason, count(*) as n from m group by 1"),
    "lc_sampling_features": (sampling_features, f"with {META_SQL} select object, round(ln(1 + n_obs), 6) as log_n, round(n_bands / 6.0, 6) as band_fraction, round(ln(1 + t_span), 6) as log_span from m"),
    "agg_joint_histogram": (joint_histogram, f"with {META_SQL} select case when n_det > 10 then 2 when n_det > 3 then 1 else 0 end as det_bin, n_bands as band_bin, least(floor(t_span / 10), 3)::int as span_bin, count(*) as n from m group by all"),
    "win_islands": (
        islands,
        f"""with {OBS_SQL}, days as (select distinct object, floor(t_us / 86400000000)::bigint as day from obs), r as (select object, day, day - row_number() over (partition by object order by day) as run from days),
        g as (select object, min(day) as first, max(day) as last from r group by object, run having max(day) > min(day)), n as (select *, row_number() over (partition by object order by first)::int as n from g) select object, n, first, last from n where n <= 2""",
    ),
    "lc_band_features": (
        per_band_features,
        f"""with {OBS_SQL}, w as (select object, {", ".join(f"count(*) filter (band = '{b}') as {b}_n, sum(flux / (error * error)) filter (band = '{b}') / sum(1 / (error * error)) filter (band = '{b}') as {b}_mean, max(flux) filter (band = '{b}') as {b}_peak" for b in ("click", "purchase", "view"))} from obs group by object)
        select object, click_n, purchase_n, view_n, {", ".join(f"round({b}_{s}, 6) as {b}_{s}" for b in ("click", "purchase", "view") for s in ("mean", "peak"))}, round(click_mean - view_mean, 6) as colour from w""",
    ),
}
