"""Classification, ranking and resampling metrics that are exact on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def score_counts(pred: DataFrame, *, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives at each distinct score: what all curve metrics need, one row a score."""
    return pred.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def curve(counts: DataFrame, *, by: list[str], score: str = "score") -> DataFrame:
    """Cumulative true and false positives from the highest score down, and totals."""
    order = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    return counts.withColumns({"tp": F.sum("p").over(order), "fp": F.sum("n").over(order), "pos": F.sum("p").over(every), "neg": F.sum("n").over(every)})


def auroc(pred: DataFrame, *, by: list[str]) -> DataFrame:
    """Area under the ROC curve; ties count a half; null with one class only."""
    c = curve(score_counts(pred, by=by), by=by)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return c.groupBy(*by).agg(F.when((F.max("pos") > 0) & (F.max("neg") > 0), area / (F.max("pos") * F.max("neg"))).alias("auroc"))


def auprc(pred: DataFrame, *, by: list[str]) -> DataFrame:
    """Average precision with tied scores taken together."""
    c = curve(score_counts(pred, by=by), by=by)
    return c.groupBy(*by).agg(F.when(F.max("pos") > 0, F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("auprc"))


def at_thresholds(pred: DataFrame, steps: int, *, by: list[str]) -> DataFrame:
    """tp, fp, pos, neg at each threshold k / steps (score >= threshold), from bin counts and one running sum."""
    binned = pred.where(F.col("score").isNotNull() & ~F.isnan("score")).withColumn("k", F.floor(F.col("score") * steps + 1e-9).cast("int"))
    counts = binned.groupBy(*by, "k").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    spine = counts.select(*by).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    filled = spine.join(counts, [*by, "k"], "left").fillna(0, ["p", "n"])
    order = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*by)
    return filled.withColumns({"tp": F.sum("p").over(order), "fp": F.sum("n").over(order), "pos": F.sum("p").over(every), "neg": F.sum("n").over(every)}).withColumn("threshold", F.col("k") / F.lit(float(steps)))


def best_f1(pred: DataFrame, *, by: list[str], steps: int = 100) -> DataFrame:
    t = at_thresholds(pred, steps, by=by)
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))).otherwise(0.0)
    return t.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("k")).alias("k"))).alias("b")).select(*by, F.col("b.f1").alias("f1"), (-F.col("b.k") / F.lit(float(steps))).alias("threshold"))


def threshold_for_recall(pred: DataFrame, target: float, *, by: list[str], steps: int = 1000) -> DataFrame:
    """The highest threshold whose recall reaches the target, else the one of best recall."""
    t = at_thresholds(pred, steps, by=by).withColumn("recall", F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0))
    return t.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("recall") >= target, F.col("threshold"))), F.max_by("threshold", F.struct("recall", "threshold"))).alias("threshold"))


def calibration_error(pred: DataFrame, *, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of confidence, the last closed."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    g = pred.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg(F.col("label").cast("double")).alias("acc"))
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def confusion(pred: DataFrame, *, by: list[str], threshold: float = 0.5) -> DataFrame:
    yes, pos = F.col("score") >= threshold, F.col("label") == 1
    g = pred.groupBy(*by).agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumns({"precision": precision, "recall": recall, "f1": div(2 * precision * recall, precision + recall), "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def expected_rank(scores: DataFrame, *, by: list[str], tolerance: float = 0.0) -> DataFrame:
    """above and tied counts of each gallery (columns score, is_positive: one positive), for any tie policy.

    A positive without a valid score ranks last.
    """
    pos = F.max(F.when(F.col("is_positive"), F.col("score"))).over(Window.partitionBy(*by))
    s = scores.withColumn("__pos", pos)
    valid = F.col("score").isNotNull() & ~F.isnan("score")
    above = valid & (F.col("__pos").isNull() | F.isnan("__pos") | (F.col("score") > F.col("__pos") + tolerance))
    tied = valid & (F.abs(F.col("score") - F.col("__pos")) <= tolerance)
    return s.groupBy(*by).agg(F.count_if(above & ~F.col("is_positive")).alias("above"), F.count_if(tied & ~F.col("is_positive")).alias("tied"), F.count("*").alias("size"))


def expected_recall(k: int) -> Column:
    """Chance that the positive is among the first k if ties fall in random order."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(k) - F.col("above")) / (F.col("tied") + 1.0)))


def expected_reciprocal_rank() -> Column:
    places = F.transform(F.sequence(F.col("above") + 1, F.col("above") + F.col("tied") + 1), lambda r: 1.0 / r)
    return F.aggregate(places, F.lit(0.0), lambda a, x: a + x) / (F.col("tied") + 1)


def harmonic_macro(rows: DataFrame, *, by: list[str], size: str, value: str) -> DataFrame:
    """Mean weighed by log10 of the gallery's size."""
    w = F.log10(size)
    return rows.groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("macro"))


def average_ranks(df: DataFrame, column: str, *, by: list[str], name: str) -> DataFrame:
    order, peers = Window.partitionBy(*by).orderBy(column), Window.partitionBy(*by, column)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(peers) - 1) / F.lit(2.0))


def spearman(df: DataFrame, x: str, y: str, *, by: list[str]) -> DataFrame:
    """Spearman's rank correlation; 0 if either side has no variance."""
    r = average_ranks(average_ranks(df, x, by=by, name="__x"), y, by=by, name="__y")
    g = r.groupBy(*by).agg(F.covar_pop("__x", "__y").alias("c"), F.stddev_pop("__x").alias("a"), F.stddev_pop("__y").alias("b"))
    return g.select(*by, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / (F.col("a") * F.col("b"))).otherwise(0.0).alias("rho"))


def holm(df: DataFrame, *, by: list[str], p: str = "p", order: list[str]) -> DataFrame:
    """Holm's step-down adjusted p-values of each family."""
    w = Window.partitionBy(*by).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__raw", raw).withColumn("p_holm", F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__raw")


def robust_scale(df: DataFrame, column: str, *, by: list[str]) -> DataFrame:
    """(x - median) / scale, the scale being IQR / 1.349, else the deviation, else 1."""
    q = df.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop(column).alias("sd"))
    iqr = (F.col("q")[2] - F.col("q")[0]) / F.lit(1.349)
    scale = F.when(iqr > 0, iqr).when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return df.join(q.select(*by, F.col("q")[1].alias("median"), scale.alias("scale")), by).withColumn("z", (F.col(column) - F.col("median")) / F.col("scale"))


def trimmed_mean(df: DataFrame, column: str, *, by: list[str], part: float = 0.05) -> DataFrame:
    """Mean without the lowest and highest ``part``; the plain mean if nothing would be left."""
    w = Window.partitionBy(*by)
    cut = F.floor(F.count("*").over(w) * part)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(column))).withColumn("__cut", cut).withColumn("__n", F.count("*").over(w))
    inside = (F.col("__r") > F.col("__cut")) & (F.col("__r") <= F.col("__n") - F.col("__cut"))
    return ranked.groupBy(*by).agg(F.coalesce(F.avg(F.when(inside, F.col(column))), F.avg(column)).alias("trimmed"))


def bootstrap(groups: DataFrame, *, by: list[str], value: str, key: str, draws: int, quantiles: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """Mean and percentile interval by Poisson bootstrap: each row's weight in each draw comes from a hash of its key.

    Rows are not shuffled once per draw: partial sums over draws go out, one row a group and draw.
    """
    from ..functions.core import key_of, uniform

    r = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = uniform(key_of("boot", F.col(key), F.col("draw")))
    r = r.withColumn("u", u).withColumn("w", F.when(F.col("u") < 0.36787944117144233, 0).when(F.col("u") < 0.7357588823428847, 1).when(F.col("u") < 0.9196986029286058, 2).when(F.col("u") < 0.9810118431238462, 3).when(F.col("u") < 0.9963401531726563, 4).otherwise(5))
    means = r.groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(*[F.lit(x) for x in quantiles]))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), q.alias("q")).select(*by, "mean", *[F.col("q")[k].alias(f"q{k}") for k in range(len(quantiles))])


def sign_flip(groups: DataFrame, *, by: list[str], value: str, key: str, draws: int) -> DataFrame:
    """Two-sided permutation p of the mean: (1 + draws at least as extreme) / (1 + draws), signs from hash bits."""
    from ..functions.core import hash32, key_of

    real = groups.groupBy(*by).agg(F.avg(value).alias("mean"))
    r = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = F.when(hash32(key_of("flip", F.col(key), F.col("draw"))) % 2 == 0, 1.0).otherwise(-1.0)
    means = r.groupBy(*by, "draw").agg(F.avg(sign * F.col(value)).alias("m"))
    return means.join(real, by).groupBy(*by, "mean").agg(((F.count_if(F.abs("m") >= F.abs("mean") - 1e-12) + 1) / F.lit(draws + 1.0)).alias("p"))


def shortcut_auc(df: DataFrame, features: list[str], label: str, *, rounds: int = 50) -> DataFrame:
    """auroc of a logistic regression on the features alone: how much of the label they give away.

    Rows whose features aren't all finite are left out; the fit is distributed, and the score is of the rows it was fitted on.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..functions.core import finite

    ok = F.lit(True)
    for c in features:
        ok = ok & F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
    rows = df.where(ok).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias("label"))
    rows = VectorAssembler(inputCols=features, outputCol="__x").transform(rows)
    rows = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(rows).transform(rows)
    model = LogisticRegression(featuresCol="__z", labelCol="label", maxIter=rounds).fit(rows)
    scored = model.transform(rows).select(F.lit(1).alias("g"), vector_to_array("probability")[1].alias("score"), "label")
    return auroc(scored, by=["g"]).select("auroc")
