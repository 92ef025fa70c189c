"""Shards with offsets, datasets of parents and curves, compaction, and the writers of text formats."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.catalog import latest


def with_offsets(heads: DataFrame, rows: DataFrame, *, by: list[str], key: str) -> DataFrame:
    """Heads with start and count of their rows within a shard (``by``), in order of key; a head without rows has count 0."""
    n = rows.groupBy(*by, key).agg(F.count("*").alias("count"))
    h = heads.join(n, [*by, key], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))


def positioned(rows: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their position in the shard, as the heads' offsets count them."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def write_shards(heads: DataFrame, rows: DataFrame, path: str, *, by: list[str], key: str, order: list[str]) -> None:
    """Two tables, events with offsets and rows in their order, a folder for each shard; neither may exist."""
    with_offsets(heads, rows, by=by, key=key).write.mode("errorifexists").partitionBy(*by).parquet(f"{path}/events")
    sorted_rows = positioned(rows, by=by, order=[key, *order])
    sorted_rows.repartition(*by).sortWithinPartitions(*by, "position").write.mode("errorifexists").partitionBy(*by).parquet(f"{path}/rows")


def compacted(generations: list[DataFrame], catalog: DataFrame, *, key: str, newest: list[str], order: str) -> DataFrame:
    """The newest row of each key of all generations, with ``place`` in the catalogue's order; keys that it lacks are left out."""
    every = generations[0]
    for g in generations[1:]:
        every = every.unionByName(g, allowMissingColumns=True)
    return latest(every, [key], newest).join(catalog.select(key, F.col(order).alias("place")), key)


def compact_in_order(generations: list[DataFrame], catalog: DataFrame, path: str, *, key: str, newest: list[str], order: str, files: int) -> int:
    """Write ``compacted`` as a new table, range by range of the catalogue's order, and say how many catalogue rows it lacks."""
    out = compacted(generations, catalog, key=key, newest=newest, order=order)
    out.repartitionByRange(files, "place").sortWithinPartitions("place").write.mode("errorifexists").parquet(path)
    return catalog.join(catalog.sparkSession.read.parquet(path), key, "left_anti").count()


def dataset(parents: DataFrame, curves: DataFrame, obs: DataFrame, *, parent: str, curve: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, curves, observations) of a relational dataset: curves with ``least`` observations at least, their parents, both renumbered.

    Numbers are dense in the order of the old keys; ``parent_idx`` of a curve and ``curve_idx`` of an observation point to them.
    """
    n = obs.groupBy(curve).agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= least)
    kept = curves.join(n, curve).join(parents.select(parent), parent, "left_semi")
    number = lambda df, key, name: _numbered(df.select(key).distinct(), key, name)
    p, c = number(kept, parent, "parent_idx"), number(kept, curve, "curve_idx")
    return parents.join(p, parent), kept.join(p, parent).join(c, curve), obs.join(c, curve)


def _numbered(keys: DataFrame, key: str, name: str, width: int = 1000) -> DataFrame:
    from ..operators.ranking import positions

    return positions(keys, bucket=F.floor(F.col(key) / width), order=[key]).select(key, F.col("position").alias(name))


def write_dataset(tables: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """The three tables of ``dataset``, observations in the order of curves."""
    events, curves, obs = tables
    events.write.mode("errorifexists").parquet(f"{path}/events")
    curves.write.mode("errorifexists").parquet(f"{path}/curves")
    obs.repartitionByRange("curve_idx").sortWithinPartitions("curve_idx").write.mode("errorifexists").parquet(f"{path}/observations")


def with_parent(curves: DataFrame, parents: DataFrame, *, key: str, negatives: DataFrame | None = None, seed: str = "negative") -> DataFrame:
    """Curves with their parent's columns (parent_*) and, on demand, a random other parent's (negative_*).

    The other parent is a walk of a hashed number of steps, at least one, along the parents in hashed order.
    """
    from ..functions.core import hash32, key_of
    from ..operators.galleries import hashed_order

    named = lambda df, prefix: df.select(F.col(key), *[F.col(c).alias(prefix + c) for c in df.columns if c != key])
    out = curves.join(named(parents, "parent_"), key, "left")
    if negatives is None:
        return out
    order = hashed_order(negatives.select(key), key, n_trials=1, seed=seed).select(key, "position", "total")
    step = 1 + hash32(key_of(seed, F.col("curve"))) % F.greatest(F.col("total") - 1, F.lit(1))
    at = out.join(order, key).withColumn("__at", F.pmod(F.col("position") + step, F.col("total"))).drop("position", "total")
    other = order.select(F.col(key).alias("negative_key"), F.col("position").alias("__at")).join(named(negatives, "negative_").withColumnRenamed(key, "negative_key"), "negative_key")
    return at.join(other, "__at").drop("__at")


def write_optical(rows: DataFrame, path: str, *, kind: str) -> None:
    """One folder for each class."""
    rows.write.mode("errorifexists").partitionBy(kind).parquet(path)


def publish_latest(df: DataFrame, path: str, name: str) -> None:
    """A named version of a table and a pointer to it that later versions replace."""
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    df.sparkSession.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/latest")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/latest').first().value}")


def fixed_width(*parts: tuple[Column, str]) -> Column:
    """One line of a fixed-width format: each value by its printf format, joined by a space."""
    return F.concat_ws(" ", *[F.format_string(f, c) for c, f in parts])


def library_lines(heads: DataFrame, obs: DataFrame, *, key: str) -> DataFrame:
    """key, line number and text of a survey library: a header, a line for each observation in order of time, an end."""
    first = heads.select(key, F.lit(0).alias("part"), F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("LIBID: "), F.col(key).cast("string"), F.format_string(" RA: %.4f DEC: %.4f NOBS: %d", F.col("ra"), F.col("dec"), F.col("n"))).alias("line"))
    body = obs.select(key, F.lit(1).alias("part"), F.col("mjd").alias("at"), F.col("id").cast("long").alias("id"), fixed_width((F.lit("S:"), "%s"), (F.col("mjd"), "%10.4f"), (F.col("id"), "%9d"), (F.col("band"), "%-1s"), (F.col("zero"), "%6.2f")).alias("line"))
    last = heads.select(key, F.lit(2).alias("part"), F.lit(0.0).alias("at"), F.lit(0).cast("long").alias("id"), F.concat(F.lit("END_LIBID: "), F.col(key).cast("string")).alias("line"))
    every = first.unionByName(body).unionByName(last)
    return every.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("part", "at", "id"))).select(key, "number", "line")


def filled(template: str, values: dict[str, Column]) -> Column:
    """A document from a template: each ``KEY: anything`` line gets its value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.regexp_replace(out, F.lit(f"(?m)^{name}:.*$"), F.concat(F.lit(f"{name}: "), value.cast("string")))
    return out


def result_table(rows: DataFrame, *, line: str, column: str, value: str, columns: list[str], best: str = "max") -> DataFrame:
    """line, a column of text for each of ``columns``, and latex: the best value of a column in bold."""
    wide = rows.groupBy(line).pivot(column, columns).agg(F.max(value))
    top = {c: (F.max if best == "max" else F.min)(c).over(Window.partitionBy()) for c in columns}  # a row a model
    text = {c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("--") for c in columns}
    cell = lambda c: F.when(F.col(c) == top[c], F.concat(F.lit(r"\textbf{"), text[c], F.lit("}"))).otherwise(text[c])
    latex = F.concat(F.concat_ws(" & ", F.col(line), *[cell(c) for c in columns]), F.lit(r" \\"))
    return wide.select(line, *[text[c].alias(c) for c in columns], latex.alias("latex"))


def write_success(spark: SparkSession, path: str, manifest: dict) -> None:
    """Mark a run as done, with what it was; a second mark is an error."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/done")


def resumable(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Whether a finished run of this very manifest is there; one of another manifest is an error, none is not finished."""
    from pyspark.errors import AnalysisException

    try:
        found = json.loads(spark.read.text(f"{path}/done").first().value)
    except AnalysisException:
        return False
    if found != json.loads(json.dumps(manifest)):
        raise ValueError(f"{path} holds another run")
    return True
