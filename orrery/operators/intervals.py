"""Range joins: bucketed equi-joins with a residual predicate, and what follows from them.

A plain range predicate makes Spark compare all pairs.  Here the left side is
repeated for each time bucket that its interval touches, the right side has one
bucket, and the exact predicate is applied to what meets; each pair meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(left: DataFrame, right: DataFrame, *, lo: Column, hi: Column, at: Column, width: float, on: list[str] | None = None, how: str = "inner", dense: bool = False) -> DataFrame:
    """Pairs with ``lo <= at <= hi``; ``lo``, ``hi`` of left, ``at`` of right; ``width`` of a bucket in their unit.

    ``how``: inner, or left_semi / left_anti over the right side (rows of right inside no interval).
    ``dense``: far more pairs than rows.  Spark deals tasks by the size of its inputs, so a small table would meet in one or
    few tasks; here both sides are dealt by their keys to as many tasks as the session shuffles to.  ``lo``, ``hi`` and ``at``
    are computed where the sides meet and not shuffled.
    """
    buckets = F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long"))
    l = left.withColumn("__bucket", F.explode(F.when(lo <= hi, buckets)))  # noqa: E741
    r = right.withColumn("__bucket", F.floor(at / width).cast("long"))
    if dense:
        keys, n = [*(on or []), "__bucket"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        l, r = l.repartition(n, *keys).hint("merge"), r.repartition(n, *keys)  # noqa: E741
    l, r = l.withColumns({"__lo": lo, "__hi": hi}), r.withColumn("__at", at)  # noqa: E741
    if how == "inner":
        both = l.join(r, [*(on or []), "__bucket"]).where("__at between __lo and __hi")
        return both.drop("__bucket", "__lo", "__hi", "__at")
    keys = l.select("__bucket", "__lo", "__hi", *(on or [])).alias("l")
    r = r.alias("r")
    meets = (F.col("l.__bucket") == F.col("r.__bucket")) & F.col("r.__at").between(F.col("l.__lo"), F.col("l.__hi"))
    for c in on or []:
        meets = meets & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return r.join(keys, meets, how).drop("__bucket", "__at")


def caliper_pairs(rows: DataFrame, *, key: str, on: list[str], step: str, steps: int, at: str, width: float, distance: dict[str, Column]) -> DataFrame:
    """``on``, i < j and the ``distance`` columns (of dstep and both ``at``: a, b) of the pairs of equal ``on`` whose whole numbers ``step`` differ by at most ``steps``
    and for which b lies in [a - ``width``, a + ``width``].

    Equal rows (but for their keys) go as one through the range join, whose keys are ``on``, the step and the bucket, so a
    pair that is not in the result costs little and copies cost what they add to the result.
    """
    kinds = rows.select(*on, F.col(step).alias("__s"), F.col(at).alias("__v"), F.col(key).alias("__k")).groupBy(*on, "__s", "__v").agg(F.collect_list("__k").alias("__keys"))
    left = kinds.select(*on, F.col("__s").alias("__own"), F.col("__v").alias("a"), F.col("__keys").alias("__is"), F.explode(F.sequence(F.col("__s") - steps, F.col("__s") + steps)).alias("__s"))
    right = kinds.select(*on, "__s", F.col("__v").alias("b"), F.col("__keys").alias("__js"))
    both = interval_join(left, right, lo=F.col("a") - width, hi=F.col("a") + width, at=F.col("b"), width=2 * width, on=[*on, "__s"])
    both = both.withColumn("dstep", F.abs(F.col("__own") - F.col("__s"))).select(*on, "__is", "__js", *[c.alias(n) for n, c in distance.items()])
    spread = both.withColumn("i", F.explode("__is"))  # distances are of kinds, not of pairs
    return spread.select(*on, "i", F.explode("__js").alias("j"), *distance).where("i < j")


def caliper_part(rows: DataFrame, part: float, *, key: str, on: list[str], step: str, steps: int, at: str, width: float, distance: Column) -> DataFrame:
    """``on``, i < j and d of the pairs of ``caliper_pairs`` whose ``distance`` (of dstep and both ``at``: a, b; the same for b, a) is no
    more than their group's exact quantile ``part``.

    The quantile is of the pairs' distances, counted by kinds of equal rows; pairs are formed only of the kinds that are
    near enough.  Kinds whose keys occur twice in the table are kept apart, as equal keys are no pair.
    """
    met = rows.select(*on, F.col(step).cast("long").alias("__s"), F.col(at).alias("__v"), F.col(key).alias("__k")).where("__k is not null and __s is not null and __v is not null")
    met = met.withColumn("__twice", F.count("*").over(Window.partitionBy("__k")) > 1)
    kinds = met.groupBy(*on, "__s", "__v", "__twice").agg(F.collect_list("__k").alias("__keys"))
    side = lambda p, v: kinds.select(*on, "__s", F.col("__s").alias(f"__{p}s"), F.col("__v").alias(v), F.col("__twice").alias(f"__{p}t"), F.col("__keys").alias(f"__{p}k"))
    right = side("r", "b")
    left = side("l", "a").withColumn("__s", F.explode(F.sequence(F.col("__ls") - steps, F.col("__ls") + steps)))
    inside = lambda x, y: F.col(y).between(F.col(x) - width, F.col(x) + width)
    both = interval_join(left, right, lo=F.col("a") - width, hi=F.col("a") + width, at=F.col("b"), width=width, on=[*on, "__s"], dense=True)
    place = lambda p, v: F.struct(F.col(f"__{p}s").alias("s"), F.col(v).alias("v"), F.col(f"__{p}t").alias("t"))
    same, first = place("l", "a") == place("r", "b"), place("l", "a") < place("r", "b")
    mutual = inside("b", "a")  # at the caliper's end a may reach b and not the reverse, by the last digit
    both = both.where(same | first | ~mutual)  # else the other of the two has the pairs of either order
    either = ~same & mutual
    both = both.select(*on, F.abs(F.col("__ls") - F.col("__rs")).alias("dstep"), "a", "b", "__lk", "__rk", either.alias("__either"), same.alias("__same"), (F.col("__lt") & F.col("__rt")).alias("__check"))
    both = both.withColumn("d", distance)
    n, m = F.size("__lk").cast("long"), F.size("__rk").cast("long")
    over = lambda ok: F.aggregate("__lk", F.lit(0).cast("long"), lambda t, x: t + F.size(F.filter("__rk", lambda y: ok(x, y))))
    counted = F.when(F.col("__either"), over(lambda x, y: x != y)).otherwise(over(lambda x, y: x < y))
    number = F.when(F.col("__check") | ~(F.col("__either") | F.col("__same")), counted).when(F.col("__same"), F.floor(n * (n - 1) / 2)).otherwise(n * m)

    limit = both.groupBy(*on, "d").agg(F.sum(number).alias("n")).where("n > 0").groupBy(*on).agg(F.percentile("d", F.lit(part), F.col("n")).alias("__q"))
    near = both.join(F.broadcast(limit), on).where(F.col("d") <= F.col("__q"))  # a row a group
    spread = near.select(*on, "d", "__either", F.explode("__lk").alias("x"), "__rk").select(*on, "d", "__either", "x", F.explode("__rk").alias("y"))
    ends = spread.where((F.col("x") < F.col("y")) | (F.col("__either") & (F.col("x") != F.col("y"))))
    return ends.select(*on, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "d")


def nearest_before(left: DataFrame, right: DataFrame, *, on: list[str], left_time: str, right_time: str) -> DataFrame:
    """As-of join without pairs: both sides in one sort, each left row takes the last right row at or before it."""
    cols = [c for c in right.columns if c not in on]
    a = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1))
    b = right.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*cols).alias("__r"))
    order = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    return both.select(*left.columns, *[F.col(f"__last.{c}").alias(f"{c}_asof") for c in cols])


def rings(dt: Column, widths: list[float]) -> Column:
    """Number of the disjoint ring of |dt|: [0, w0], (w0, w1], ...; null beyond."""
    out = F.lit(None).cast("int")
    for k, w in reversed(list(enumerate(widths))):
        out = F.when(F.abs(dt) <= w, F.lit(k)).otherwise(out)
    return out


def division(rows: DataFrame, *, item: str, of: str) -> DataFrame:
    """Items that occur with every value of ``of``."""
    n = rows.select(of).distinct().count()
    return rows.groupBy(item).agg(F.count_distinct(of).alias("n")).where(F.col("n") == n).select(item)


def in_windows(points: DataFrame, rows: DataFrame, *, key: str, lo: Column, at: Column, width: int, value: str) -> DataFrame:
    """``key``, n and least ``value`` of the rows with ``lo <= at <= lo + width``, for each point; no pairs are formed.

    A window as wide as a bucket covers the end of one bucket and the start of the next: a running count and minimum
    over each bucket's rows, from either end, gives both parts.  Points without rows have n = 0.
    """
    bucket = lambda t: F.floor(t / width).cast("long")
    p = points.select(F.col(key).alias("__key"), lo.alias("__lo")).withColumn("__b", bucket(F.col("__lo")))
    ends = F.array(F.struct(F.col("__lo").alias("t"), F.col("__b").alias("b"), F.lit(0).alias("side")), F.struct((F.col("__lo") + width).alias("t"), (F.col("__b") + 1).alias("b"), F.lit(1).alias("side")))
    p = p.select("__key", F.inline(ends)).withColumn("v", F.lit(None).cast(rows.schema[value].dataType))
    r = rows.select(F.lit(None).cast(points.schema[key].dataType).alias("__key"), at.alias("t"), bucket(at).alias("b"), F.lit(-1).alias("side"), F.col(value).alias("v"))
    reach = lambda t: Window.partitionBy("b").orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(r)
    for name, w in (("up", reach(F.asc("t"))), ("down", reach(F.desc("t")))):
        both = both.withColumn(name, F.struct(F.count_if(F.col("side") == -1).over(w).alias("n"), F.min("v").over(w).alias("least")))
    part = F.when(F.col("side") == 0, F.col("down")).otherwise(F.col("up"))
    parts = both.where("side >= 0").select(F.col("__key").alias(key), part.alias("x"))
    return parts.groupBy(key).agg(F.sum("x.n").alias("n"), F.min("x.least").alias("least"))


def next_other(rows: DataFrame, *, key: str, group: str, time: str, within: int) -> DataFrame:
    """``key`` and pick: the first row (by ``time``, ``key``) of another ``group`` in (time, time + ``within``], null if there
    is none.  No pairs are formed, and a row of null group has no pick and is none.

    In a bucket of ``within`` a row looks at the first later row; if that is of its own group, at the first row of
    another group after it.  What the next bucket can add are its first row and its first of another group.
    """
    r = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(time).alias("t")).withColumn("b", F.floor(F.col("t") / within).cast("long"))
    some = r.where("g is not null and t is not null")
    order = Window.partitionBy("b").orderBy("t", "k")
    some = some.withColumn("change", F.when(F.coalesce(F.lag("g").over(order) != F.col("g"), F.lit(False)), F.struct("t", "k")))
    after = Window.partitionBy("b").orderBy(F.desc("t"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("turn", F.min("change").over(after))  # where rows of another group start
    later = Window.partitionBy("b").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("first", F.min(F.struct("t", "k", "g", "turn")).over(later))
    heads = some.groupBy((F.col("b") - 1).alias("b")).agg(F.min(F.struct("t", "k", "g", "turn")).alias("head"))
    both = some.join(heads, "b", "left")
    other = lambda x: F.when(F.col(f"{x}.g") != F.col("g"), F.struct(F.col(f"{x}.t").alias("t"), F.col(f"{x}.k").alias("k"))).otherwise(F.col(f"{x}.turn"))
    found = F.coalesce(other("first"), other("head"))
    near = both.select("k", found.alias("found"), "t").select("k", F.when(F.col("found.t") - F.col("t") <= within, F.col("found")).alias("found"))
    every = near.unionByName(r.where("g is null or t is null").select("k", F.lit(None).cast(near.schema["found"].dataType).alias("found")))
    return every.groupBy("k").agg(F.min("found").alias("found")).select(F.col("k").alias(key), F.col("found.k").alias("pick"))
