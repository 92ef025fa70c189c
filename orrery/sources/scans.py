"""Scans: configurations, file discovery, selected rows, posterior tables, outcomes, logs and studies."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators.catalog import latest


def expanded(value, names: dict[str, str] | None = None):
    """``${NAME}`` in any text of a nested configuration, from ``names`` or the environment; an unknown name is an error."""
    known = os.environ if names is None else names

    def one(m: re.Match) -> str:
        if m[1] not in known:
            raise KeyError(f"${{{m[1]}}} is not set")
        return known[m[1]]

    if isinstance(value, dict):
        return {k: expanded(v, names) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, names) for v in value]
    return re.sub(r"\$\{(\w+)\}", one, value) if isinstance(value, str) else value


def read_config(path: str, required: dict[str, type | tuple], names: dict[str, str] | None = None) -> dict:
    """A YAML or JSON configuration with its names expanded; a missing or mistyped required key is an error that lists all."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    found = expanded(found or {}, names)
    wrong = [k for k, t in required.items() if not isinstance(found.get(k), t) or (isinstance(found.get(k), bool) and t in (int, float))]
    if wrong:
        raise ValueError(f"missing or of the wrong type: {sorted(wrong)}")
    return found


def merged_config(*layers: dict) -> dict:
    """Later layers over earlier ones, key by key; None overrides nothing, and a key that the first layer lacks is an error."""
    out = dict(layers[0])
    for layer in layers[1:]:
        unknown = sorted(set(layer) - set(layers[0]))
        if unknown:
            raise KeyError(f"unknown settings: {unknown}")
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def discovered(spark: SparkSession, path: str, pattern: str = r"(?i)\.fits(\.gz)?$") -> DataFrame:
    """path, folder, name, size of the files below a folder whose name matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    parts = F.split("path", "/")
    files = files.withColumns({"name": F.element_at(parts, -1), "folder": F.element_at(parts, -2)})
    return files.where(F.col("name").rlike(pattern)).select("path", "folder", "name", "size")


def head_pairs(files: DataFrame) -> DataFrame:
    """folder, head, phot: each ..._HEAD file with the ..._PHOT file of the same stem; a head without partner has null."""
    stem = lambda kind: F.regexp_extract("name", rf"(?i)^(.*)_{kind}\.fits(\.gz)?$", 1)
    heads = files.withColumn("stem", stem("HEAD")).where("stem <> ''").select("folder", "stem", F.col("path").alias("head"))
    phots = files.withColumn("stem", stem("PHOT")).where("stem <> ''").select("folder", "stem", F.col("path").alias("phot"))
    return heads.join(phots, ["folder", "stem"], "left").select("folder", "head", "phot")


def matching_lines(lines: DataFrame, pattern: str, names: list[str], *, line: str = "value") -> DataFrame:
    """Every match of a pattern in every line, in the columns' types of text: one row a match."""
    n = len(names)
    found = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(pattern), k + 1).alias(f"g{k}") for k in range(n)])
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, F.explode(found).alias("m")).select(*rest, *[F.col(f"m.g{k}").alias(name) for k, name in enumerate(names)])


def selected_rows(df: DataFrame, wanted: DataFrame, row: str) -> DataFrame:
    """The rows named, each once however often it is named."""
    return df.join(wanted.select(row).distinct(), row, "left_semi")


def like_any(df: DataFrame, key: str, patterns: dict[str, dict[str, str]]) -> DataFrame:
    """key, label for each label whose patterns (column: LIKE pattern) match in any of their columns; a label once a row."""
    hit = lambda p: F.coalesce(F.greatest(F.lit(False), *[F.coalesce(F.col(c).like(x), F.lit(False)) for c, x in p.items()]), F.lit(False))
    labels = F.filter(F.array(*[F.when(hit(p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(labels).alias("label"))


def posterior_medians(df: DataFrame, columns: list[str], *, by: list[str]) -> DataFrame:
    """by, the median of each column over its finite values, and how many rows were finite in all."""
    ok = [C.finite(F.col(c)) for c in columns]
    every: Column = ok[0]
    for o in ok[1:]:
        every = every & o
    return df.groupBy(*by).agg(*[F.percentile(F.when(o, F.col(c)), F.lit(0.5)).alias(c) for c, o in zip(columns, ok, strict=True)], F.count_if(every).alias("finite"))


def histogram_distribution(counts: DataFrame, *, bin_: str, n: str) -> DataFrame:
    """bin, p, upto: a histogram of counts as probabilities and their running sum, empty and negative bins left out."""
    from pyspark.sql.window import Window

    h = counts.where((F.col(n) > 0) & (F.col(bin_) >= 0)).groupBy(bin_).agg(F.sum(n).alias("n"))  # a row a bin
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return h.withColumn("p", p).select(bin_, "p", F.sum("p").over(Window.orderBy(bin_).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))


def study_trials(trials: DataFrame, params: DataFrame, names: list[str]) -> DataFrame:
    """Finished trials with a column for each parameter: the latest row of a trial counts."""
    done = latest(trials, ["trial"], ["at"]).where("state = 'COMPLETE'")
    wide = params.groupBy("trial").pivot("name", names).agg(F.max("value"))
    return done.join(wide, "trial", "left")


def folder_class(folder: Column, classes: dict[str, str]) -> Column:
    """Class of a folder's name: the first token that it holds, else unknown."""
    low, out = F.lower(folder), F.lit("unknown")
    for token, name in reversed(classes.items()):
        out = F.when(low.contains(token), name).otherwise(out)
    return out


def attributes(spark: SparkSession, path: str) -> dict:
    """The manifest beside a published table, without reading the table."""
    return json.loads(spark.read.text(f"{path}.manifest").first().value)
