"""Retrieval galleries: a positive and its distractors for each trial and query, nested by size.

Random choices are hashes of keys.  Distractors are drawn by walking on from the
query's own place in a hashed order of the pool, so a gallery of n costs n rows
and no query meets the whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C
from . import ranking as R


def trials(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def random_positive(rows: DataFrame, *, query: str, row: str, n_trials: int, seed: str) -> DataFrame:
    """trial, query, row: one row of each query for each trial, that of least hash."""
    h = C.hash32(C.key_of(seed, F.col("trial"), F.col(row)))
    best = trials(rows.select(query, row), n_trials).groupBy("trial", query).agg(F.min(F.struct(h.alias("h"), F.col(row).alias("r"))).alias("b"))
    return best.select("trial", query, F.col("b.r").alias(row))


def hashed_order(pool: DataFrame, key: str, *, n_trials: int, seed: str) -> DataFrame:
    """trial, key, position, total: the pool in an order of its own for each trial."""
    p = trials(pool.select(key), n_trials).withColumn("h", C.hash32(C.key_of(seed, F.col("trial"), F.col(key))))
    placed = R.positions(p, bucket=F.col("trial") * 1024 + F.floor(F.col("h") / (1 << 22)), order=["trial", "h", key])
    total = F.floor(F.col("total") / n_trials)
    return placed.select("trial", key, (F.col("position") - F.col("trial") * total).alias("position"), total.alias("total"))


def walk(starts: DataFrame, order: DataFrame, n: int, *, key: str, name: str) -> DataFrame:
    """The next n of the order after each start (trial, ..., position): adds slot (1..n) and ``name``."""
    steps = starts.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__at", F.pmod(F.col("position") + F.col("slot"), F.col("total"))).drop("position", "total")
    there = order.select("trial", F.col("position").alias("__at"), F.col(key).alias(name))
    return steps.join(there, ["trial", "__at"]).drop("__at")


def allocation(size: Column, share: float) -> Column:
    """Negatives of the first kind in a gallery of ``size``: the share rounded half up, one of each kind at least."""
    n = size - 1
    return F.least(F.greatest(F.floor(n * F.lit(share) + 0.5), F.lit(1)), n - 1).cast("int")


def mixed(positives: DataFrame, kin: DataFrame, others: DataFrame, *, sizes: list[int], share: float, n_trials: int, seed: str) -> DataFrame:
    """trial, query, size, slot, kind, row: the positive in slot 0, rows of other parents, then rows of the other kind.

    ``positives`` (trial, query, row), ``kin`` (parent, row) with the queries among the parents, ``others`` (row).  A
    gallery holds a parent once and never the query's own; each size's negatives begin those of the next.
    """
    n_kin = max(min(max(int((s - 1) * share + 0.5), 1), s - 2) for s in sizes)
    n_other = max(s - 1 - min(max(int((s - 1) * share + 0.5), 1), s - 2) for s in sizes)
    parents = hashed_order(kin.select("parent").distinct(), "parent", n_trials=n_trials, seed=f"{seed}-parent")
    starts = positives.select("trial", "query").join(parents.withColumnRenamed("parent", "query"), ["trial", "query"])
    one = random_positive(kin, query="parent", row="row", n_trials=n_trials, seed=f"{seed}-row")
    relatives = walk(starts, parents, n_kin, key="parent", name="parent").where("parent <> query").join(one, ["trial", "parent"])
    pool = hashed_order(others, "row", n_trials=n_trials, seed=f"{seed}-other")
    total = pool.groupBy("trial").agg(F.max("total").alias("total"))
    begin = positives.select("trial", "query").join(F.broadcast(total), "trial").withColumn("position", C.hash32(C.key_of(f"{seed}-start", F.col("trial"), F.col("query"))) % F.col("total"))  # a row a trial
    strangers = walk(begin, pool, n_other, key="row", name="row")
    each = F.explode(F.array(*[F.lit(s) for s in sizes]))
    first = positives.select("trial", "query", F.lit("positive").alias("kind"), F.lit(0).alias("slot"), "row").withColumn("size", each)
    a = relatives.select("trial", "query", F.lit("kin").alias("kind"), "slot", "row").withColumn("size", each).where(F.col("slot") <= allocation(F.col("size"), share))
    b = strangers.select("trial", "query", F.lit("other").alias("kind"), "slot", "row").withColumn("size", each).where(F.col("slot") <= F.col("size") - 1 - allocation(F.col("size"), share))
    b = b.withColumn("slot", F.col("slot") + allocation(F.col("size"), share))
    return first.unionByName(a).unionByName(b).select("trial", "query", "size", "slot", "kind", "row")


def gallery_faults(galleries: DataFrame, parent_of: DataFrame) -> DataFrame:
    """fault, n: galleries that hold the query's own parent, a parent or row twice, or are short of their size."""
    g = galleries.join(parent_of, "row", "left").groupBy("trial", "query", "size")
    f = g.agg(
        F.count("*").alias("n"), F.count_if((F.col("kind") == "kin") & (F.col("parent") == F.col("query"))).alias("own"),
        (F.count_if(F.col("kind") == "kin") - F.count_distinct(F.when(F.col("kind") == "kin", F.col("parent")))).alias("twice"), (F.count("*") - F.count_distinct("row")).alias("repeated"),
    )
    return f.agg(F.count_if(F.col("own") > 0).alias("own_parent"), F.count_if(F.col("twice") > 0).alias("parent_twice"), F.count_if(F.col("repeated") > 0).alias("row_twice"), F.count_if(F.col("n") < F.col("size")).alias("undersized"), F.count("*").alias("galleries"))


def scored(galleries: DataFrame, queries: DataFrame, candidates: DataFrame, score: Column) -> DataFrame:
    """Gallery rows (query, row) with ``score`` of the query's and the candidate's columns: the score table is as long as the galleries."""
    return galleries.join(queries, "query").join(candidates, "row", "left").withColumn("score", score)


def enriched(ranks: DataFrame, galleries: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Outcome rows with attributes of their gallery, one row a gallery."""
    attributes = galleries.groupBy(*key).agg(*[F.any_value(c).alias(c) for c in columns], F.count("*").alias("actual_size"))
    return ranks.join(attributes, key, "left")


def with_attributes(rows: DataFrame, lookup: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the lookup's columns; an unknown key raises an error that names it."""
    known = lookup.withColumn("__known", F.lit(True))
    named = F.concat_ws("|", *[F.col(c).cast("string") for c in key])
    return rows.join(known, key, "left").where(F.when(F.col("__known"), True).otherwise(F.raise_error(F.concat(F.lit("unknown key "), named)).cast("boolean"))).drop("__known")


def conditional_metrics(rows: DataFrame, *, by: list[str], conditions: dict[str, Column], ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """condition, n, recall_at_k, mrr over galleries (score, is_positive), all of them and those with a condition on the positive."""
    top = F.max(F.when(F.col("is_positive"), F.col("score"))).over(Window.partitionBy(*by))
    facts = [F.max(F.when(F.col("is_positive"), c.cast("int"))).alias(f"__{n}") for n, c in conditions.items()]
    g = rows.withColumn("__top", top).groupBy(*by).agg((F.count_if(~F.col("is_positive") & (F.col("score") > F.col("__top"))) + 1).alias("rank"), *facts)
    names = F.array(F.lit("all"), *[F.when(F.col(f"__{n}") == 1, F.lit(n)) for n in conditions])
    each = g.withColumn("condition", F.explode(F.filter(names, lambda x: x.isNotNull())))
    return each.groupBy("condition").agg(F.count("*").alias("n"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}") for k in ks], F.avg(1.0 / F.col("rank")).alias("mrr"))


def windowed_hard_negative(pairs: DataFrame, *, by: list[str], dt: str, score: str, row: str, lo: float, hi: float) -> DataFrame:
    """by, row, in_window: the best-scored candidate whose signed time lies in [lo, hi], else the best of all."""
    inside = F.col(dt).between(lo, hi)
    best = lambda ok: F.max(F.when(ok, F.struct(F.col(score).alias("s"), (-F.col(row)).alias("r"))))
    g = pairs.groupBy(*by).agg(best(inside).alias("a"), best(F.lit(True)).alias("b"))
    return g.select(*by, (-F.coalesce("a", "b")["r"]).alias(row), F.col("a").isNotNull().alias("in_window"))


def by_time_then_level(rows: DataFrame, n: int, *, by: list[str], dt: str, level: str, key: str, seed: str) -> DataFrame:
    """The first n of each group by |dt|, then level, then a hash: adds slot (from 1)."""
    order = Window.partitionBy(*by).orderBy(F.abs(dt), level, C.hash32(C.key_of(seed, F.col(key))), key)
    return rows.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n)


def identity(galleries: DataFrame, by: list[str], order: list[str], row: str) -> DataFrame:
    """by, digest: SHA-256 of the gallery's rows in order, equal for equal galleries."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(row).alias("__row")))), lambda x: x["__row"].cast("string"))
    return galleries.groupBy(*by).agg(F.sha2(F.array_join(rows, ","), 256).alias("digest"))
