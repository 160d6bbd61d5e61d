"""Static rasters and vegetation composites: nearest-cell and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions import geo, timeops
from emberframe.operators.tiles import PIXEL, TILE


def pivot_layers(cells: DataFrame, keys: list[str], layers: tuple[str, ...] = k.STATIC_FEATURES) -> DataFrame:
    """Layer-long raster cells to one column per layer; the layer list is fixed, so no extra pass."""
    return cells.groupBy(*keys).agg(
        *[F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name) for name in layers]
    )


def nearest_static(
    points: DataFrame, cells: DataFrame, origin: tuple[float, float], step: float, *values: str
) -> DataFrame:
    """Nearest raster cell in metres; points outside the raster take the edge cell."""
    grid = cells.select(
        geo.snap_index(F.col("x"), origin[0], step).alias("_ix"),
        geo.snap_index(F.col("y"), origin[1], step).alias("_iy"),
        *values,
    )
    edge = grid.agg(
        F.struct(
            F.min("_ix").alias("x0"), F.max("_ix").alias("x1"), F.min("_iy").alias("y0"), F.max("_iy").alias("y1")
        ).alias("e")
    ).scalar()
    keyed = points.withColumn("_e", edge).withColumns(
        {
            "_ix": geo.clamp(geo.snap_index(F.col("easting"), origin[0], step), F.col("_e.x0"), F.col("_e.x1")),
            "_iy": geo.clamp(geo.snap_index(F.col("northing"), origin[1], step), F.col("_e.y0"), F.col("_e.y1")),
        }
    )
    return keyed.join(grid, ["_ix", "_iy"], "left").drop("_ix", "_iy", "_e")


def with_statics(tile_days: DataFrame, statics: DataFrame, keys: tuple[str, ...] = (*TILE, *PIXEL)) -> DataFrame:
    """Statics onto tile-day pixels; tiles without statics keep NULLs."""
    return tile_days.join(statics, list(keys), "left")


def _vegetation_cell(lon, lat, lon0: float, lat0: float, per_degree: float):
    return geo.centre_index(lon, lon0, per_degree), geo.centre_index(lat, lat0, per_degree, -1)


def nearest_vegetation(
    points: DataFrame, composites: DataFrame, values: list[str],
    lon0: float = k.VEGETATION_LON0, lat0: float = k.VEGETATION_LAT0,
    per_degree: float = k.VEGETATION_CELLS_PER_DEGREE,
) -> DataFrame:
    """Vegetation of the nearest cell of the chosen composite (``time_start`` on both sides)."""
    cx, cy = _vegetation_cell(F.col("lon"), F.col("lat"), lon0, lat0, per_degree)
    grid = composites.select("time_start", cx.alias("_vx"), cy.alias("_vy"), *values)
    edge = grid.agg(
        F.struct(
            F.min("_vx").alias("x0"), F.max("_vx").alias("x1"), F.min("_vy").alias("y0"), F.max("_vy").alias("y1")
        ).alias("e")
    ).scalar()
    keyed = points.withColumn("_e", edge).withColumns(
        {
            "_vx": geo.clamp(cx, F.col("_e.x0"), F.col("_e.x1")),
            "_vy": geo.clamp(cy, F.col("_e.y0"), F.col("_e.y1")),
        }
    )
    return keyed.join(grid, ["time_start", "_vx", "_vy"], "left").drop("_vx", "_vy", "_e")


def asof_composite(
    burn_days: DataFrame, schedule: DataFrame, lag_days: int = k.COMPOSITE_DAYS,
    lookback_days: int = k.COMPOSITE_LOOKBACK_DAYS, fire_days: DataFrame | None = None,
) -> DataFrame:
    """Newest composite finished before each burn day, not older than the fire's floor.

    ``burn_days(id, year, dob, burn_date)``; the floor is 1 January + (first DOB of the fire - 33) d, where
    the first day is that among ``fire_days(id, year, dob)`` if given: all days and tiles of a fire, also
    those on which ``burn_days`` does not name it.
    The as-of search is a running maximum over distinct calendar days (a few thousand rows for
    any volume of pixels); fires and pixels later need nothing but equi-joins.  The newest
    finished composite decides alone: if it is below the floor, so are all older ones.
    """
    done = schedule.select(F.date_add("time_start", lag_days).alias("burn_date"), F.col("time_start"))
    calendar = (
        burn_days.select("burn_date", F.lit(None).cast("date").alias("time_start"))
        .unionByName(done)
        .groupBy("burn_date")
        .agg(F.max("time_start").alias("time_start"))
    )
    so_far = Window.orderBy("burn_date").rowsBetween(Window.unboundedPreceding, 0)
    newest = calendar.select("burn_date", F.max("time_start").over(so_far).alias("time_start"))
    first = (burn_days if fire_days is None else fire_days).groupBy("id", "year").agg(F.min("dob").alias("_first"))
    first = first.withColumn("_fd", timeops.dob_to_date(F.col("year"), F.col("_first")))
    floor = F.date_add("_fd", F.lit(1 - lookback_days))
    return (
        burn_days.join(newest, "burn_date", "left")
        .join(first, ["id", "year"])
        .withColumn("time_start", F.when(F.col("time_start") >= floor, F.col("time_start")))
        .drop("_first", "_fd")
    )


def burn_dates(days: DataFrame) -> DataFrame:
    return days.withColumn("burn_date", timeops.dob_to_date(F.col("year"), F.col("dob")))
