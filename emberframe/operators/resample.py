"""Resampling a raster onto another lattice with a separable kernel."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions import geo

STRIP = 64  # source columns per strip


def cubic_bspline(t: Column) -> Column:
    """Cubic B-spline: four weights that sum to one, zero from a distance of two cells on."""
    a = F.abs(t)
    near, far = (4 - 6 * a * a + 3 * a * a * a) / 6, (2 - a) * (2 - a) * (2 - a) / 6
    return F.when(a < 1, near).when(a < 2, far).otherwise(F.lit(0.0))


def source_strips(cells: DataFrame, halo: int, value: str = "v") -> DataFrame:
    """Rows (_block, _iy, _strip): 64 neighbouring cells of a source row as an array, and ``halo`` cells more on each side.

    Each cell goes to its own block and, near a border, to the next one; a strip has a fixed length. Of cells that
    repeat an index the largest value counts.
    """
    block = lambda by: F.floor((F.col("ix") + by) / STRIP)
    placed = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).select(
        "ix", F.col("iy").cast("long").alias("_iy"), F.col(value).cast("double").alias("_v"), F.explode(F.sequence(block(-halo), block(halo))).alias("_block")
    ).withColumn("_at", (F.col("ix") - F.col("_block") * STRIP + halo).cast("int"))
    unique = placed.repartition("_block", "_iy").groupBy("_block", "_iy", "_at").agg(F.max("_v").alias("_v"))
    known = unique.groupBy("_block", "_iy").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(STRIP + 2 * halo - 1))
    return known.select("_block", "_iy", F.transform(places, lambda i: F.try_element_at("_m", i)).alias("_strip"))


def kernel_warp(
    targets: DataFrame, cells: DataFrame, fx: Column, fy: Column, value: str = "v", scale: tuple[float, float] = (1.0, 1.0),
    kernel: Callable[[Column], Column] = cubic_bspline, radius: int = 2,
) -> DataFrame:
    """``targets`` with ``value``: the kernel-weighted mean of the source cells around each target.

    ``cells`` has integer columns ix and iy; ``fx`` and ``fy`` say where a target lies in units of these indexes (whole numbers are cell
    centres), so any projection between the two lattices will do. ``scale`` is the target step in source cells: above one the
    kernel widens by it, so that no source cell is passed over. Cells without a value have no weight, and the weights that
    are left are brought to a sum of one; a target without any known cell is NULL.

    A target meets 2 * radius * scale strips, not cells: an equi-join on strip and row, then one aggregate. Rows of ``targets`` are unique.
    """
    reach = [max(1, math.ceil(radius * max(s, 1.0))) for s in scale]
    widen = [F.lit(float(max(s, 1.0))) for s in scale]
    columns = targets.columns
    base = targets.withColumns({"_fx": fx.cast("double"), "_fy": fy.cast("double")}).withColumns(
        {"_x": F.floor("_fx"), "_y": F.floor("_fy"), "_block": F.floor(F.floor("_fx") / STRIP)}
    )
    rows = base.withColumn("_iy", F.explode_outer(F.sequence(F.col("_y") - reach[1] + 1, F.col("_y") + reach[1])))
    met = rows.join(source_strips(cells, reach[0], value), ["_block", "_iy"], "left")
    first = (F.col("_x") - F.col("_block") * STRIP + 1).cast("int")  # the strip starts ``halo`` cells before its block
    total, weight = F.lit(0.0), F.lit(0.0)
    for j in range(2 * reach[0]):
        cell = F.get("_strip", first + j)
        w = F.when(cell.isNotNull(), kernel((F.col("_x") - reach[0] + 1 + j - F.col("_fx")) / widen[0])).otherwise(0.0)
        total, weight = total + w * F.coalesce(cell, F.lit(0.0)), weight + w
    down = kernel((F.col("_iy") - F.col("_fy")) / widen[1])
    sums = met.select(*columns, (down * total).alias("_t"), (down * weight).alias("_w")).groupBy(*columns).agg(F.sum("_t").alias("_t"), F.sum("_w").alias("_w"))
    return sums.select(*columns, F.when(F.col("_w") > 1e-9, F.col("_t") / F.col("_w")).alias(value))


def lattice_centres(tile_rows: DataFrame, grid: int = k.GRID_SIZE, pixel: float = k.PIXEL_SIZE) -> DataFrame:
    """Every cell of the given tiles with its centre: easting, northing."""
    span = float(grid * pixel)
    line = lambda: F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    return tile_rows.withColumn("pixel_y", line()).withColumn("pixel_x", line()).withColumns({
        "easting": F.col("tile_col") * span + (F.col("pixel_x") + 0.5) * float(pixel),
        "northing": (F.col("tile_row") + 1) * span - (F.col("pixel_y") + 0.5) * float(pixel),
    })


def warp_geographic(
    tile_rows: DataFrame, cells: DataFrame, origin: tuple[float, float], step: tuple[float, float], value: str = "v",
    grid: int = k.GRID_SIZE, pixel: float = k.PIXEL_SIZE, scale: tuple[float, float] = (1.0, 1.0),
) -> DataFrame:
    """A raster in degrees (cell ix, iy centred at origin + index * step) on the lattice of the given tiles."""
    lon, lat = geo.unproject_lambert(F.col("easting"), F.col("northing"))
    targets = lattice_centres(tile_rows, grid, pixel)
    fx, fy = (lon - F.lit(origin[0])) / F.lit(step[0]), (lat - F.lit(origin[1])) / F.lit(step[1])
    return kernel_warp(targets, cells, fx, fy, value, scale).drop("easting", "northing")
