"""Summaries of scores, times and probabilities; partial sums go out of each task, not rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C


def moments(df: DataFrame, column: str, *, by: list[str]) -> DataFrame:
    """by, n, nonfinite, mean, std: from sums over the finite values."""
    x, ok = F.col(column), C.finite(F.col(column))
    g = df.groupBy(*by).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("n"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("nonfinite"), F.sum(F.when(ok, x)).alias("s"), F.sum(F.when(ok, x * x)).alias("q"))
    mean = F.col("s") / F.col("n")
    return g.select(*by, "n", "nonfinite", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def latency(df: DataFrame, column: str, *, by: list[str]) -> DataFrame:
    """by, mean, std, p50, p90, p95, lo, hi, throughput (rows a unit)."""
    g = df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.percentile(column, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("q"), F.min(column).alias("lo"), F.max(column).alias("hi"), (F.count("*") / F.sum(column)).alias("throughput"))
    return g.select(*by, "mean", "std", *[F.col("q")[k].alias(p) for k, p in enumerate(("p50", "p90", "p95"))], "lo", "hi", "throughput")


def medians(df: DataFrame, columns: list[str], *, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns], F.count("*").alias("n"))


def source_score(df: DataFrame, column: str, *, source: str, macro: float, gates: dict[str, float] | None = None) -> DataFrame:
    """macro, worst, worst_source, score (macro weight and the rest on the worst), passed: whether every gated source reaches its gate."""
    s = df.groupBy(source).agg(F.avg(column).alias("m"))
    ok = [F.coalesce(F.min(F.when(F.col(source) == k, F.col("m"))) >= v, F.lit(False)) for k, v in (gates or {}).items()]
    return s.agg(F.avg("m").alias("macro"), F.min("m").alias("worst"), F.min_by(source, F.struct("m", source)).alias("worst_source"), (macro * F.avg("m") + (1 - macro) * F.min("m")).alias("score"), reduce(lambda a, b: a & b, ok, F.lit(True)).alias("passed"))


def weighted_score(df: DataFrame, column: str, *, group: str, weights: dict) -> DataFrame:
    """score: the groups' means, weighed; groups without a weight are left out."""
    g = df.groupBy(group).agg(F.avg(column).alias("m"))
    w = reduce(lambda out, kv: out.when(F.col(group) == kv[0], kv[1]), list(weights.items())[1:], F.when(F.col(group) == next(iter(weights)), next(iter(weights.values()))))
    return g.withColumn("w", w.cast("double")).agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("score"))


def rows_a_group(df: DataFrame, by: list[str]) -> DataFrame:
    """median, lo, hi, mean of the groups' numbers of rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"))


def shares(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n, share: a confusion table whose rows add up to 1."""
    g = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def logit_density(df: DataFrame, p: str, *, by: list[str], width: float, edge: float = 1e-3) -> DataFrame:
    """by, bin, n: histogram of the log-odds of probabilities kept ``edge`` away from 0 and 1."""
    q = F.least(F.greatest(F.col(p), F.lit(edge)), F.lit(1 - edge))
    return df.groupBy(*by, F.floor(F.ln(q / (1 - q)) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def distinct_sum(df: DataFrame, *, by: list[str], item: str, weights: DataFrame, weight: str) -> DataFrame:
    """by, items, total: the weight of the distinct items of each group."""
    return df.select(*by, item).distinct().join(weights.select(item, weight), item).groupBy(*by).agg(F.count("*").alias("items"), F.sum(weight).alias("total"))


def bin_weights(df: DataFrame, bin_: str, weight: str) -> DataFrame:
    return df.groupBy(bin_).agg(F.sum(weight).alias("total"), F.count("*").alias("n"))


def mixed_outcome(df: DataFrame, *, by: list[str], score: str, positive: str, kin: str, key: str) -> DataFrame:
    """by, rank_all, rank_kin, rank_other, margin, top: ranks of the positive among all, its kin and the others, its lead, and the kind of the best row."""
    top = F.max(F.when(F.col(positive), F.col(score))).over(Window.partitionBy(*by))
    g = df.withColumn("__top", top).groupBy(*by)
    above = ~F.col(positive) & (F.col(score) > F.col("__top"))
    kind = F.when(F.col(positive), "positive").when(F.col(kin), "kin").otherwise("other")
    return g.agg(
        (F.count_if(above) + 1).alias("rank_all"), (F.count_if(above & F.col(kin)) + 1).alias("rank_kin"), (F.count_if(above & ~F.col(kin)) + 1).alias("rank_other"),
        (F.max(F.when(F.col(positive), F.col(score))) - F.max(F.when(~F.col(positive), F.col(score)))).alias("margin"), F.max_by(kind, F.struct(score, key)).alias("top"),
    )


def mean_of_batches(df: DataFrame, column: str, *, batch: Column) -> DataFrame:
    """batch_mean, batches: the mean of the batches' means, the last short one counting as one."""
    return df.groupBy(batch.alias("__b")).agg(F.avg(column).alias("m")).agg(F.avg("m").alias("batch_mean"), F.count("*").alias("batches"))


def endpoints(df: DataFrame, column: str, *, scopes: list[list[str]], names: list[str]) -> DataFrame:
    """The names (``all`` where a scope lacks them), n, mean, positive, t, p and p_holm of each scope: a two-sided normal test of the
    mean, adjusted step-down over all endpoints."""
    from .metrics import holm

    g = df.groupingSets([tuple(s) for s in scopes], *names).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.avg((F.col(column) > 0).cast("double")).alias("positive"), (F.avg(column) / (F.stddev_samp(column) / F.sqrt(F.count("*")))).alias("t"))
    g = g.select(*[F.coalesce(F.col(n).cast("string"), F.lit("all")).alias(n) for n in names], "n", "mean", "positive", "t")
    # Upper tail of the normal distribution by a rational approximation of the error function (fixed values; error below 1.5e-7).
    z = F.abs("t") / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * z)
    p = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-z * z)
    return holm(g.withColumn("p", p).withColumn("__f", F.lit(1)), by=["__f"], order=names).drop("__f")  # a row an endpoint


def histogram_between(df: DataFrame, column: str, bins: int, *, low: float, high: float) -> DataFrame:
    """bin, n: equal bins between two percentiles, both ends inside."""
    q = df.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("q"))
    r = df.join(F.broadcast(q)).where(F.col(column).between(F.col("q")[0], F.col("q")[1]))  # one row
    b = F.least(F.floor((F.col(column) - F.col("q")[0]) / (F.col("q")[1] - F.col("q")[0]) * bins), F.lit(bins - 1))
    return r.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def harmonic(sizes: DataFrame, n: str) -> DataFrame:
    """n, h: 1 + 1/2 + ... + 1/n for each size, from a table as long as the largest."""
    most = sizes.agg(F.max(n).alias("m"))
    table = most.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("m").cast("long"))).alias("k"))
    summed = table.withColumn("h", F.sum(1.0 / F.col("k")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # a row a size
    return sizes.select(n).distinct().join(summed, F.col(n) == F.col("k")).select(n, "h")


def kept_checkpoints(steps: DataFrame, *, step: str, value: str, least: float) -> DataFrame:
    """Adds keep: whether the value beats the best before it by more than ``least``."""
    before = F.max(value).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1))  # a row a checkpoint
    return steps.withColumn("keep", F.coalesce(F.col(value) > before + least, F.lit(True)))


def deltas(df: DataFrame, column: str, *, by: list[str], model: str, new: str, base: str) -> DataFrame:
    """by, delta: mean under one model less that under another; scopes that lack one are left out."""
    g = df.groupBy(*by).agg(F.avg(F.when(F.col(model) == new, F.col(column))).alias("a"), F.avg(F.when(F.col(model) == base, F.col(column))).alias("b"))
    return g.where("a is not null and b is not null").select(*by, (F.col("a") - F.col("b")).alias("delta"))


def lattice(events: DataFrame, rows: DataFrame, *, key: str, least: int, failed: Column) -> DataFrame:
    """key, kind: type1 for failed events, pos with ``least`` rows, type2 with fewer."""
    n = rows.groupBy(key).agg(F.count("*").alias("__n"))
    kind = F.when(failed, "type1").when(F.coalesce("__n", F.lit(0)) >= least, "pos").otherwise("type2")
    return events.join(n, key, "left").select(key, kind.alias("kind"))


def panel_coverage(df: DataFrame, *, scenario: str, coordinate: str) -> DataFrame:
    """scenario, coordinates, n, complete: whether the scenario has every coordinate."""
    total = df.agg(F.count_distinct(coordinate).alias("t"))
    g = df.groupBy(scenario).agg(F.count_distinct(coordinate).alias("coordinates"), F.count("*").alias("n"))
    return g.join(F.broadcast(total)).select(scenario, "coordinates", "n", (F.col("coordinates") == F.col("t")).alias("complete"))  # one row


def unreferenced(rows: DataFrame, known: DataFrame, *, key: str) -> DataFrame:
    """key, n: keys of rows that the known table lacks."""
    return rows.join(known.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def ranked_trials(trials: DataFrame, weights: dict[str, float], *, trial: str, rows: Column, batch: int, epochs: int) -> DataFrame:
    """trial, objective (weighed metrics), steps (batches of all epochs), rank: the largest objective first."""
    value = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()])
    t = trials.select(trial, value.alias("objective"), (epochs * F.ceil(rows / batch)).alias("steps"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("objective"), trial)))  # a row a trial
