"""How the test tables play the domain's roles; the same roles in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as C

OBS_SQL = """obs as (select user_id as object, event_type as band, epoch_us(ts) + 3506716800000000 as t_us, value as flux, 0.05 * abs(value) + 1 + (event_id % 7) as error, event_id as seq, event_id % 3 as flag from events)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as photometry: user = object, event type = band, value = flux."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("object"), F.col("event_type").alias("band"), C.micros(F.col("ts")).alias("t_us"), F.col("value").alias("flux"),
        (F.lit(0.05) * F.abs("value") + 1 + F.col("event_id") % 7).alias("error"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("flag"),
    )


PARENT_SQL = """parent as (select c_custkey as object, n_name as source, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as parent events, nation as source class, region as its family."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    n = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # nations and regions are fixed tables
    joined = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return joined.select(F.col("c_custkey").alias("object"), F.col("n_name").alias("source"), F.col("r_name").alias("region"))
