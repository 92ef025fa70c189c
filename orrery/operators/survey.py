"""Survey operators: visibility, scan schedules of tiled sky areas, triggers, candidates in time and sky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import core as C

DAY = 86_400.0
SIDEREAL_YEAR = 365.256363004
FIRST_OBSERVATION = 900_000_001


def visible(altitude: Column, sun: Column, airmass: Column, *, least_altitude: float = 20.0, most_sun: float = -12.0) -> Column:
    """Whether a target can be observed: high enough, the sun low enough, a finite airmass."""
    return F.coalesce(C.finite(airmass) & (altitude >= least_altitude) & (sun <= most_sun), F.lit(False))


def annual_triggers(events: DataFrame, n: int, *, trigger: str, first: float, last: float, followup: float = 4.0, year: float = SIDEREAL_YEAR, earliest: int | None = None, whole: bool = True) -> DataFrame:
    """``events`` with scenario (from 0) and mjd: the first n whole sidereal years from the trigger that the survey covers with the follow-up.

    Years before the trigger count unless ``earliest`` says from which on.  An event that the survey covers fewer times
    raises an error, or has the scenarios there are if not ``whole``.
    """
    k = F.ceil((F.lit(first) - F.col(trigger)) / F.lit(year)) - 1  # a year more at both ends: the dates decide
    k = k if earliest is None else F.greatest(k, F.lit(earliest))
    held = F.floor((F.lit(last - followup) - F.col(trigger)) / F.lit(year)) + 1
    years = F.when(k <= held, F.sequence(k, held)).otherwise(F.array().cast("array<bigint>"))
    dates = F.filter(F.transform(years, lambda y: F.col(trigger) + y * F.lit(year)), lambda t: (t >= first) & (t + F.lit(followup) <= last))
    out = events.withColumn("__dates", F.slice(dates, 1, n))
    if whole:
        out = out.where(F.when(F.size("__dates") >= n, True).otherwise(F.raise_error(F.concat(F.lit("scenarios covered: "), F.size("__dates").cast("string"))).cast("boolean")))
    return out.select("*", F.posexplode("__dates").alias("scenario", "mjd")).drop("__dates")


def scans(events: DataFrame, windows: DataFrame, *, strategy: dict, overhead: float, change: float) -> DataFrame:
    """event, night, scan_index, kind, branch, start, until, filters, exposure, tiles: the scans of each event's windows.

    ``events`` (event, gold, tiles); ``windows`` (event, night, start, end).  In the first night gold events have up to three
    full scans, spread over the window, and one filter again at its end if there is time for one full scan only; others
    have one scan, and every later night has one.
    """
    seconds = lambda filters, exposure: C.scan_seconds(filters, F.lit(float(exposure)), F.col("tiles"), overhead, change)
    first, later, repeat = (F.array(*[F.lit(f) for f in strategy[k]]) for k in ("first", "later", "repeat"))
    w = windows.join(events, "event").withColumn("long", (F.col("end") - F.col("start")) * DAY).withColumn("whole", seconds(first, strategy["first_exposure"]))
    opening = w.where("night = 0").withColumn("full", F.when(~F.col("gold"), -1).otherwise(F.least(F.lit(3), F.floor(F.col("long") / F.col("whole")).cast("int"))))
    branch = F.when(F.col("full") < 0, "night0_one_silver_scan").when(F.col("full") == 0, "night0_partial_scan").when(F.col("full") == 1, "night0_one_full_scan_plus_r_if_time").when(F.col("full") == 2, "night0_two_full_scans").otherwise("night0_three_full_scans")
    gap = F.when(F.col("full") > 1, (F.col("long") - F.col("full") * F.col("whole")) / (F.col("full") - 1)).otherwise(0.0)
    row = lambda index, kind, start, filters, exposure: F.struct(index.cast("int").alias("scan_index"), F.lit(kind).alias("kind"), start.alias("at"), filters.alias("filters"), F.lit(float(exposure)).alias("exposure"))
    spread = F.transform(F.sequence(F.lit(0), F.greatest(F.col("full"), F.lit(1)) - 1), lambda i: row(i, "night0_full", F.col("start") + i * (F.col("whole") + F.col("gap")) / DAY, first, strategy["first_exposure"]))
    done = F.col("start") + F.col("whole") / DAY
    again = F.when((F.col("full") == 1) & (done < F.col("end")), F.array(row(F.lit(1), "night0_repeat", F.greatest(done, F.col("end") - seconds(repeat, strategy["first_exposure"]) / DAY), repeat, strategy["first_exposure"]))).otherwise(F.slice(spread, 1, 0))
    opening = opening.withColumn("branch", branch).withColumn("gap", gap)
    night0 = opening.select("event", "night", "branch", "end", "tiles", F.inline(F.concat(spread, again)))
    nights = w.where("night > 0").select("event", "night", F.lit("later").alias("branch"), "end", "tiles", F.inline(F.array(row(F.lit(0), "later_night_full", F.col("start"), later, strategy["later_exposure"]))))
    return night0.unionByName(nights).select("event", "night", "scan_index", "kind", "branch", F.col("at").alias("start"), F.col("end").alias("until"), "filters", "exposure", "tiles")


def exposures(scans_: DataFrame, *, overhead: float, change: float) -> DataFrame:
    """One row for each exposure that ends within its scan's window: midpoint mjd, band_order, band, tile, observation id in order of time."""
    each = scans_.select("*", F.posexplode("filters").alias("band_order", "band")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    step = F.col("exposure") + F.lit(overhead)
    middle = F.col("band_order") * (F.col("tiles") * step + F.lit(change)) + F.col("tile") * step + F.col("exposure") / 2
    out = each.withColumn("mjd", F.col("start") + middle / DAY).where(F.col("mjd") + F.col("exposure") / (2 * DAY) <= F.col("until") + 1e-12)
    order = Window.partitionBy("event").orderBy("mjd", "band_order", "tile")
    return out.withColumn("observation_id", F.row_number().over(order) + (FIRST_OBSERVATION - 1)).select("event", "observation_id", "night", "scan_index", "kind", "branch", "band_order", "band", "tile", "exposure", "mjd")


def tile_coverage(exposed: DataFrame, tiles: DataFrame) -> DataFrame:
    """event, night, probability: of the distinct tiles (event, tile, probability) that were observed."""
    return exposed.select("event", "night", "tile").distinct().join(tiles, ["event", "tile"]).groupBy("event", "night").agg(F.sum("probability").alias("probability"))


def draw_cells(cells: DataFrame, n: int, *, seed: str, level: float) -> DataFrame:
    """map_id, draw, cell_id: n draws with replacement from each map's cells inside the credible level, in proportion to prob.

    A uniform hash of map and draw falls into one cell's part of the running sum: one sort of draws and cells, no pairs.
    """
    from . import sky
    from .intervals import nearest_before

    inside = sky.credible_levels(cells).where((F.col("level") <= level) & (F.col("prob") > 0))
    w = Window.partitionBy("map_id")
    order = w.orderBy("cell_id")
    c = inside.withColumn("total", F.sum("prob").over(w)).withColumn("from", F.coalesce(F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.col("total"))
    draws = inside.select("map_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("u", C.uniform(C.key_of(seed, F.col("map_id"), F.col("draw"))))
    got = nearest_before(draws, c.select("map_id", "from", "cell_id"), on=["map_id"], left_time="u", right_time="from")
    return got.select("map_id", "draw", F.col("cell_id_asof").alias("cell_id"))


def distance_at(u: Column, mu: Column, sigma: Column, *, steps: int = 128) -> Column:
    """Inverse of the distance distribution r^2 N(r; mu, sigma) at u, by a trapezoid sum over four deviations either side (r > 0)."""
    low = F.greatest(mu - 4 * sigma, sigma * 1e-6)
    h = (mu + 4 * sigma - low) / steps
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: low + k * h)
    weight = F.transform(grid, lambda r: r * r * F.exp(-0.5 * ((r - mu) / sigma) * ((r - mu) / sigma)))
    parts = F.zip_with(F.slice(weight, 1, steps), F.slice(weight, 2, steps), lambda a, b: (a + b) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"), F.lit(0).alias("k"))

    def step(a, x):
        reached = a["at"].isNull() & (a["sum"] + x >= u * total)
        return F.struct((a["sum"] + x).alias("sum"), F.when(reached, a["k"] + (u * total - a["sum"]) / x).otherwise(a["at"]).alias("at"), (a["k"] + 1).alias("k"))

    return low + h * F.coalesce(F.aggregate(parts, start, step, lambda a: a["at"]), F.lit(float(steps)))


def panel(draws: DataFrame, truth: DataFrame, mode: str) -> DataFrame:
    """Coordinate rows of each map: its draws, ``with_truth`` the true position first, ``fixed`` all at the true distance, ``both`` together.

    ``draws`` (map_id, draw, ra, dec, distance), ``truth`` (map_id, ra, dec, distance); with the truth, the last draw gives way.
    """
    cols = ["map_id", "sample_index", "ra", "dec", "distance", "is_true"]
    d = draws.select("map_id", F.col("draw").alias("sample_index"), "ra", "dec", "distance", F.lit(False).alias("is_true"))
    if mode in ("fixed", "both"):
        d = d.drop("distance").join(truth.select("map_id", "distance"), "map_id")
    if mode in ("with_truth", "both"):
        last = F.max("sample_index").over(Window.partitionBy("map_id"))
        d = d.withColumn("__last", last).where(F.col("sample_index") < F.col("__last")).withColumn("sample_index", F.col("sample_index") + 1)
        d = d.select(*cols).unionByName(truth.select("map_id", F.lit(0).alias("sample_index"), "ra", "dec", "distance", F.lit(True).alias("is_true")))
    return d.select(*cols)


def in_footprint(points: DataFrame, footprint: DataFrame, *, pixel: str) -> DataFrame:
    """Adds inside: whether the point's pixel is in the footprint."""
    return points.join(footprint.select(pixel).distinct().withColumn("__in", F.lit(True)), pixel, "left").withColumn("inside", F.coalesce("__in", F.lit(False))).drop("__in")


def tile_of(points: DataFrame, tiles: DataFrame, *, on: list[str]) -> DataFrame:
    """Adds tile: that of the point's pixel, -1 outside all tiles."""
    return points.join(tiles.select(*on, "tile"), on, "left").withColumn("tile", F.coalesce("tile", F.lit(-1)))


def moc_cells(rows: DataFrame, *, uniq: str, density: str) -> DataFrame:
    """order, pixel, ra, dec, area (square degrees) and prob of the rows of a multi-order map (density per steradian)."""
    order = C.uniq_order(F.col(uniq))
    out = rows.withColumn("order", order).withColumn("pixel", C.uniq_pixel(F.col(uniq), F.col("order")))
    ra, dec = C.pix2ang_nest(F.col("order"), F.col("pixel"), 12)
    steradian = F.lit(4 * 3.141592653589793) / (F.lit(12.0) * F.pow(F.lit(4.0), "order"))
    return out.withColumns({"ra": ra, "dec": dec, "area": C.pixel_area_deg2(F.col("order")), "prob": F.col(density) * steradian})


def synthetic_candidates(events: DataFrame, n: int, *, key: str, within: float, seed: str) -> DataFrame:
    """n candidates of each event: dt uniform in [0, within] and a point uniform on the sphere, from hashes."""
    c = events.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = lambda what: C.uniform(C.key_of(seed, what, F.col(key), F.col("candidate")))
    return c.withColumns({"dt": F.lit(within) * u("t"), "ra": 360.0 * u("ra"), "dec": F.degrees(F.asin(2.0 * u("z") - 1.0))})


def levels_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """point_id, map_id, cell_id, level: each distinct point's nearest cell of its map and that cell's credible level."""
    from . import sky

    near = sky.nearest_cell(points.dropDuplicates(["point_id", "map_id"]), cells)
    return near.join(sky.credible_levels(cells).select("map_id", "cell_id", "level").hint("merge"), ["map_id", "cell_id"]).select("point_id", "map_id", "cell_id", "level")
