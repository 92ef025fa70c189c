"""Sky operators over cell tables (map_id, cell_id, x, y, z, area, prob) and pixel expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .nearest import half_away, nearest_rows


def density() -> Column:
    """Probability per area; cells without area have none."""
    return F.when(F.col("area") > 0, F.col("prob") / F.col("area")).otherwise(0.0)


def credible_levels(cells: DataFrame) -> DataFrame:
    """Adds ``level``: the share of probability in cells of at least this density; ties share a level.

    Sums run over distinct densities, not cells, so the window is as short as the map has densities.
    """
    d = cells.withColumn("density", density())
    steps = d.groupBy("map_id", "density").agg(F.sum("prob").alias("p"))
    w = Window.partitionBy("map_id")
    steps = steps.withColumn("level", F.sum("p").over(w.orderBy(F.desc("density")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("p").over(w)).drop("p")
    return d.join(steps.hint("merge"), ["map_id", "density"])  # neither side is bounded


def credible_area(cells: DataFrame, level: float) -> DataFrame:
    """Area of the smallest set of cells that holds ``level``, at least the densest cell's."""
    c = credible_levels(cells)
    return c.groupBy("map_id").agg(F.coalesce(F.sum(F.when(F.col("level") <= level, F.col("area"))), F.max_by("area", F.struct("density", -F.col("cell_id")))).alias("area"))


def nearest_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Each point (point_id, map_id, px, py, pz) with its map's cell of largest dot product, ties to the smaller cell.

    Both are unit vectors, so the largest product (12 digits) belongs to the nearest ones.
    """
    dot = lambda a, b: -half_away(a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2], 12)
    p = points.select("point_id", "map_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    near = nearest_rows(p, cells, group="map_id", id_="point_id", key="cell_id", at=["x", "y", "z"], score=dot, slack=2e-6)
    return near.select("point_id", "map_id", "cell_id")


def tiles(cells: DataFrame, fov: float) -> DataFrame:
    """Adds ``tile``: cells ranked by density are dealt to tiles of equal area ``fov``, at least one, at most ceil(area / fov)."""
    w = Window.partitionBy("map_id")
    ranked = cells.withColumn("density", density()).withColumn("rank", F.row_number().over(w.orderBy(F.desc("density"), "cell_id")))
    last = F.greatest(F.lit(1), F.ceil(F.sum("area").over(w) / fov)) - 1
    return ranked.withColumn("tile", F.least(F.floor((F.col("rank") - 1) * F.col("area") / fov), last).cast("int"))


def classify(df: DataFrame, snr: str, area: str) -> Column:
    """Follow-up class by signal and area: closed at 12, 30 and 100, open at 500."""
    return F.when(F.col(snr) <= 12, "baseline").when(F.col(area) <= 30, "gold").when(F.col(area) <= 100, "gold_scan").when(F.col(area) < 500, "silver").otherwise("baseline")


def summary(cells: DataFrame) -> DataFrame:
    """Probability-weighted mean and deviation of distance for each map."""
    p, m, s = F.col("prob"), F.col("distmu"), F.col("distsigma")
    g = cells.groupBy("map_id").agg(F.sum(p).alias("p"), F.sum(p * m).alias("m"), F.sum(p * (m * m + s * s)).alias("q"))
    return g.select("map_id", (F.col("m") / F.col("p")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("p") - F.pow(F.col("m") / F.col("p"), F.lit(2.0)))).alias("std"))
