"""Catalogue operators: normalisation, filters with an audit, contracts, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_column(df: DataFrame, names: list[str]) -> Column | None:
    """The first of ``names`` that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(have[n.lower()]) for n in names if n.lower() in have), None)


def parse_bool(x: Column, *, strict: bool = True) -> Column:
    """true/1 and false/0 in any case and with white space around; others raise an error or give null."""
    low = F.lower(F.trim(x.cast("string")))
    other = F.raise_error(F.concat(F.lit("not a boolean: "), low)).cast("boolean") if strict else F.lit(None).cast("boolean")
    return F.when(low.isin("true", "1", "1.0"), True).when(low.isin("false", "0", "0.0"), False).when(low.isNotNull(), other)


def clean_label(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isNull() | low.isin("", "none", "nan"), "unknown").otherwise(low)


def complete(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns of ``defaults`` (name: type, value), missing ones filled, present ones cast where that works."""
    have = set(df.columns)
    return df.select(*[(F.col(c).try_cast(t) if c in have else F.lit(v).cast(t)).alias(c) for c, (t, v) in defaults.items()])


def range_audit(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """(rows inside all closed ranges, one row of counts: kept, and outside by each column alone), in one pass each."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).between(*r), F.lit(False)) for c, r in ranges.items()])
    audit = df.agg(F.count_if(ok).alias("kept"), *[F.count_if(~F.coalesce(F.col(c).between(*r), F.lit(False))).alias(f"outside_{c}") for c, r in ranges.items()])
    return df.where(ok), audit


def dedupe_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def latest(df: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The last row of each key: one aggregate, no sort."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max(F.struct(*by, *[c for c in rest if c not in by])).alias("r"))
    return last.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def offenders(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (a predicate that should hold; null counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def require(df: DataFrame, rules: dict[str, Column], key: str, most: int = 10) -> None:
    """Raise an error that names the ``most`` least offending keys of each broken rule; no rule's offenders are gathered whole."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    each = df.select(F.col(key).alias("__key"), F.explode(broken).alias("rule")).distinct()
    few = each.withColumn("__n", F.row_number().over(Window.partitionBy("rule").orderBy("__key"))).where(F.col("__n") <= most)  # kept short in each task by the limit on the rank
    found: dict[str, list] = {}
    for r in few.orderBy("rule", "__n").collect():
        found.setdefault(r["rule"], []).append(r["__key"])
    if found:
        raise ValueError(f"contract broken: {found}")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def offsets_valid(df: DataFrame, *, by: list[str], order: list[str], start: str, count: str) -> DataFrame:
    """Adds ``valid``: whether each start is the sum of the counts before it."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("valid", F.col(start) == F.coalesce(F.sum(count).over(before), F.lit(0)))


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put in place of those of equal key."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def remaining(all_rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return all_rows.join(done.select(*key).distinct(), key, "left_anti")


def digest(*columns: Column | str) -> Column:
    """SHA-256 of the columns' canonical text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns]), 256)
