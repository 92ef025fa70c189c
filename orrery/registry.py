"""All queries of the library: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import bridge, catalogs, contracts, curves, extras, galleries, joins, lightcurves, scores, sources, survey

QUERIES: dict = {**lightcurves.QUERIES, **catalogs.QUERIES, **scores.QUERIES, **joins.QUERIES, **extras.QUERIES, **galleries.QUERIES, **contracts.QUERIES, **survey.QUERIES, **bridge.QUERIES, **sources.QUERIES, **curves.QUERIES}


def queries() -> dict:
    return {name: q[0] for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in QUERIES.items() if q[1]}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["lc_delay_distribution"][0](spark, sf_dir)
