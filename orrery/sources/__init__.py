"""Sources and sinks: catalogues, status logs, text scans, FITS-like pointers, published tables with manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import latest


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are skipped, others must be whole numbers."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").cast("long").alias("id"))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON documents with ``events``: the latest row of each simulation; malformed documents are skipped."""
    schema = "created_utc string, submission_id string, task_index long, events array<struct<simulation_id: long, status: string, reason: string>>, _corrupt string"
    docs = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    rows = docs.where("_corrupt is null").select("created_utc", "submission_id", "task_index", F.explode("events").alias("e"))
    return latest(rows.select(F.col("e.simulation_id").alias("simulation_id"), "created_utc", "task_index", "submission_id", F.col("e.status").alias("status"), F.col("e.reason").alias("reason")), ["simulation_id"], ["created_utc", "task_index"])


def scan_text(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """One row a file: the groups of the pattern's first match (empty: none)."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select("file", *[F.regexp_extract("value", pattern, k + 1).alias(n) for k, n in enumerate(names)])


def attach_pointers(heads: DataFrame, rows: DataFrame, *, low: str = "ptr_min", high: str = "ptr_max", at: str = "pos") -> DataFrame:
    """Head rows with the observations at positions low..high (1-based, closed), within a file."""
    spread = heads.withColumn(at, F.explode(F.sequence(F.col(low), F.col(high))))
    return spread.join(rows, ["file", at])


def with_priority(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several sources, each key from the first source that has it."""
    tagged = [s.withColumn("__priority", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    best = every.groupBy(*key).agg(F.min("__priority").alias("__priority"))
    return every.join(best, [*key, "__priority"], "left_semi").drop("__priority")


def hdf5_reader(spark: SparkSession):
    """Registers ``hdf5`` as a data source (path, dataset) where h5py is installed; one partition a file."""
    import h5py  # noqa: F401
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def partitions(self) -> list:
            return [InputPartition(p) for p in self.options["path"].split(",")]

        def read(self, partition):
            import h5py

            with h5py.File(partition.value) as f:
                group = f[self.options["dataset"]]
                columns = [group[c] for c in self.options["columns"].split(",")]
                for at in range(0, len(columns[0]), 8192):
                    yield from zip(*[c[at : at + 8192].tolist() for c in columns], strict=True)

    class Hdf5(DataSource):
        @classmethod
        def name(cls) -> str:
            return "hdf5"

        def schema(self) -> str:
            return self.options["schema"]

        def reader(self, schema: T.StructType) -> Reader:
            return Reader(self.options)

    spark.dataSource.register(Hdf5)


def table_digest(df: DataFrame) -> str:
    """A digest of a table that doesn't depend on the order of rows."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    n, low, high = df.select(F.sha2(F.concat_ws("\1", *cells), 256).alias("h")).agg(F.count("*"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")), F.sum(F.conv(F.substring("h", 16, 15), 16, 10).cast("decimal(38,0)"))).first()
    return f"{n}-{low or 0:x}-{high or 0:x}" if not hasattr(low, "as_tuple") else f"{n}-{int(low):x}-{int(high):x}"


def publish(df: DataFrame, path: str, *, version: int = 1, **about: object) -> dict:
    """Write a table that must not exist, check what was written, and put a manifest beside it."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    written = spark.read.parquet(path)
    manifest = {"schema_version": version, "rows": written.count(), "schema": json.loads(written.schema.json()), "digest": table_digest(written), **about}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.manifest")
    return manifest


def verified(spark: SparkSession, path: str) -> DataFrame:
    """A published table, if it still is what its manifest says."""
    manifest = json.loads(spark.read.text(f"{path}.manifest").first().value)
    df = spark.read.parquet(path)
    if table_digest(df) != manifest["digest"]:
        raise ValueError(f"{path} differs from its manifest")
    return df


def write_gzip_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "gzip").csv(path, header=True)


def compact(old: DataFrame, new: DataFrame, key: list[str], by: list[str], path: str, files: int) -> None:
    """Latest row of each key of two generations, sorted within files by key, as a new table."""
    latest(old.unionByName(new, allowMissingColumns=True), key, by).repartition(files, *key).sortWithinPartitions(*key).write.mode("errorifexists").parquet(path)
