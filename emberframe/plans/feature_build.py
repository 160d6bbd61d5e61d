"""Burn points to daily features per tile pixel.

Dense rows (tile-days x grid**2) appear at the end.  Everything that varies slowly is joined before
that: coordinates and statics per tile, weather per (tile-day, weather cell), vegetation per
(tile, composite).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions import geo
from emberframe.operators import surface, tiles, weather
from emberframe.operators.tiles import PIXEL, TILE, TILE_DAY
from emberframe.session import cut_lineage


@dataclass
class Inputs:
    """Tables of a feature build and the steps of their grids."""

    points: DataFrame
    tz_regions: DataFrame
    weather_hourly: DataFrame
    composites: DataFrame
    statics: DataFrame  # x, y and one column per static feature
    static_origin: tuple[float, float]
    static_step: float
    grid: int = k.GRID_SIZE
    pixel: float = k.PIXEL_SIZE
    weather_step: float = 0.1
    vegetation_grid: tuple[float, float, float] = (k.VEGETATION_LON0, k.VEGETATION_LAT0, k.VEGETATION_CELLS_PER_DEGREE)
    composite_days: int = k.COMPOSITE_DAYS
    composite_lookback: int = k.COMPOSITE_LOOKBACK_DAYS


def lattice(tile_list: DataFrame, grid: int, pixel: float) -> DataFrame:
    """All cells of each tile with metres and degrees of their origin."""
    axis = F.sequence(F.lit(0), F.lit(grid - 1))
    cells = tile_list.select(*TILE, F.explode(axis).alias("pixel_y")).withColumn("pixel_x", F.explode(axis))
    e, n = geo.cell_origin(F.col("tile_col"), F.col("tile_row"), F.col("pixel_x"), F.col("pixel_y"), grid, pixel)
    cells = cells.withColumns({"easting": e, "northing": n})
    lon, lat = geo.unproject_lambert(F.col("easting"), F.col("northing"))
    return cells.withColumns({"lon": lon, "lat": lat})


def tile_day_table(inputs: Inputs, located: DataFrame) -> DataFrame:
    """One row per tile-day: times of the primary fire's first row."""
    meta = tiles.tile_day_metadata(located, inputs.tz_regions)
    first = tiles.primary_fire(tiles.tile_fires(located)).select(
        *TILE_DAY, F.col("primary_fire").alias("id"), F.col("primary_fireday").alias("fireday")
    )
    return first.join(meta.drop("lon", "lat", "dob"), ["year", *TILE, "id", "fireday"])


def build(inputs: Inputs, with_burn: bool = True) -> DataFrame:
    """Dense daily features: weather, vegetation and statics per pixel, burn flags on request.

    Three small tables are written on the way (folded points, tile-days, lattice with statics).
    The join that makes the rows dense is the last but one; its inputs are per tile and composite
    on one side and per tile-day and weather cell on the other, so no dense table is shuffled to
    look anything up.  ``with_burn`` adds the one dense exchange; without it the burn flags stay
    in their sparse table for the channel assembly.
    """
    located = tiles.locate(inputs.points, inputs.grid, inputs.pixel)
    folded = cut_lineage(tiles.fold_points(located), "folded-points")
    days = cut_lineage(tile_day_table(inputs, folded), "tile-days")
    step = inputs.weather_step
    cells = surface.nearest_static(
        lattice(days.select(*TILE).distinct(), inputs.grid, inputs.pixel),
        inputs.statics, inputs.static_origin, inputs.static_step, *_static_columns(inputs.statics),
    )
    features = weather.hourly_features(inputs.weather_hourly)
    edge = weather.grid_extent(features).select(F.struct("*").alias("e")).scalar()
    inside = F.col("lat").between(F.col("e.lat_lo"), F.col("e.lat_hi")) & F.col("lon").between(
        F.col("e.lon_lo"), F.col("e.lon_hi")
    )
    cells = cells.withColumns(
        {"cy": geo.snap_index(F.col("lat"), 0.0, step), "cx": geo.snap_index(F.col("lon"), 0.0, step), "e": edge}
    ).withColumn("in_weather", F.coalesce(inside, F.lit(False)))
    cells = cut_lineage(cells.drop("e", "easting", "northing"), "lattice")

    dated = surface.asof_composite(
        surface.burn_dates(days.select(*TILE_DAY, "id")), inputs.composites,
        inputs.composite_days, inputs.composite_lookback, folded.select("id", "year", "dob"),
    ).select(*TILE_DAY, "time_start")

    # Weather: a tile meets a handful of weather cells, so look those up per tile-day.
    nodes = cells.select(*TILE, "cy", "cx").distinct().withColumns(
        {"lat": F.round(F.col("cy") * step, 6), "lon": F.round(F.col("cx") * step, 6)}
    )
    daily = weather.daily_weather(
        days.select(*TILE_DAY, "month", "noon_utc", "end_utc").join(dated, list(TILE_DAY)).join(nodes, list(TILE)),
        features, step,
    ).select(*TILE_DAY, "month", F.col("time_start").alias("_start"), "cy", "cx", *k.WEATHER_FEATURES)

    # Vegetation: the composite depends on the day, its pixels only on (tile, composite).
    lon0, lat0, per_degree = inputs.vegetation_grid
    green = surface.nearest_vegetation(
        dated.select(*TILE, "time_start").distinct().join(cells, list(TILE)), inputs.composites,
        list(k.VEGETATION_FEATURES), lon0, lat0, per_degree,
    )
    match = [F.col("g." + c) == F.col("d." + c) for c in (*TILE, "cy", "cx")]
    dense = green.alias("g").join(
        daily.alias("d"), [*match, F.col("g.time_start").eqNullSafe(F.col("d._start"))]
    ).select(
        *[F.col("d." + c) for c in (*TILE_DAY, "month")],
        *[F.col("g." + c) for c in (*PIXEL, "lon", "lat", "time_start", *k.VEGETATION_FEATURES)],
        *[F.col("g." + c) for c in _static_columns(inputs.statics)],
        *[F.when(F.col("g.in_weather"), F.col("d." + c)).alias(c) for c in k.WEATHER_FEATURES],
    )
    if not with_burn:
        return dense
    # The last write decides within a fire; across fires a pixel burns if any of them says so.
    flags = ("firearea", "cumuarea")
    per_fire = folded.groupBy(*TILE_DAY, "id", "fireday", *PIXEL).agg(*[F.max_by(c, "last_seq").alias(c) for c in flags])
    burned = per_fire.groupBy(*TILE_DAY, *PIXEL).agg(*[F.max(c).alias(c) for c in flags])
    dense = dense.join(burned, [*TILE_DAY, *PIXEL], "left")
    return dense.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in flags})


def _static_columns(statics: DataFrame) -> list[str]:
    return [c for c in statics.columns if c not in ("x", "y")]
