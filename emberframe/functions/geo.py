"""Map projection (EPSG:3347) and tile lattice as Column algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import constants as k


def _conformal(lat: float) -> float:
    s = math.sin(lat)
    ratio = (1 - k.GRS80_E * s) / (1 + k.GRS80_E * s)
    return math.tan(math.pi / 4 - lat / 2) / ratio ** (k.GRS80_E / 2)


def _parallel_radius(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (k.GRS80_E * math.sin(lat)) ** 2)


def lambert_parameters() -> dict[str, float]:
    """Cone constants of the projection, folded once in Python."""
    p1, p2 = math.radians(k.PARALLEL_1_DEG), math.radians(k.PARALLEL_2_DEG)
    m1, m2 = _parallel_radius(p1), _parallel_radius(p2)
    t1, t2 = _conformal(p1), _conformal(p2)
    n = (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2))
    scale = k.GRS80_A * m1 / (n * t1**n)
    rho0 = scale * _conformal(math.radians(k.ORIGIN_LAT_DEG)) ** n
    return {"n": n, "scale": scale, "rho0": rho0}


_CONE = lambert_parameters()


def project_lambert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees (NAD83) to easting/northing in metres."""
    phi = F.radians(lat)
    es = F.lit(k.GRS80_E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(k.GRS80_E / 2))
    rho = F.lit(_CONE["scale"]) * F.pow(t, F.lit(_CONE["n"]))
    theta = F.lit(_CONE["n"]) * F.radians(lon - F.lit(k.ORIGIN_LON_DEG))
    easting = F.lit(k.FALSE_EASTING) + rho * F.sin(theta)
    northing = F.lit(k.FALSE_NORTHING + _CONE["rho0"]) - rho * F.cos(theta)
    return easting, northing


def unproject_lambert(easting: Column, northing: Column, steps: int = 5) -> tuple[Column, Column]:
    """Metres back to degrees; the latitude is a fixed-point iteration unrolled ``steps`` times.

    ``exp(-e*atanh(e*sin(phi)))`` names ``phi`` once, so unrolling stays linear in size.
    """
    x = easting - F.lit(k.FALSE_EASTING)
    y = F.lit(k.FALSE_NORTHING + _CONE["rho0"]) - northing
    t = F.pow(F.hypot(x, y) / F.lit(_CONE["scale"]), F.lit(1 / _CONE["n"]))
    lon = F.degrees(F.atan2(x, y) / F.lit(_CONE["n"])) + F.lit(k.ORIGIN_LON_DEG)
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(steps):
        shrink = F.exp(F.lit(-k.GRS80_E) * F.atanh(F.lit(k.GRS80_E) * F.sin(phi)))
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * shrink)
    return lon, F.degrees(phi)


def with_projection(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add ``easting`` and ``northing``; missing input columns are an analysis-time error."""
    missing = [c for c in (lon, lat) if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are required to project points")
    easting, northing = project_lambert(F.col(lon), F.col(lat))
    return df.withColumns({"easting": easting, "northing": northing})


def _cell(offset: Column, pixel: float, grid: int) -> Column:
    return F.least(F.greatest(F.floor(offset / F.lit(float(pixel))), F.lit(0)), F.lit(grid - 1)).cast("int")


def with_tile(
    df: DataFrame,
    easting: str = "easting",
    northing: str = "northing",
    grid: int = k.GRID_SIZE,
    pixel: float = k.PIXEL_SIZE,
) -> DataFrame:
    """Add ``tile_col, tile_row, pixel_x, pixel_y``; rows count from the top edge of the tile."""
    span = F.lit(float(grid * pixel))
    e, n = F.col(easting), F.col(northing)
    col, row = F.floor(e / span).cast("int"), F.floor(n / span).cast("int")
    return df.withColumns(
        {
            "tile_col": col,
            "tile_row": row,
            "pixel_x": _cell(e - col * span, pixel, grid),
            "pixel_y": _cell((row + 1) * span - n, pixel, grid),
        }
    )


def tile_id(col: Column | str = "tile_col", row: Column | str = "tile_row") -> Column:
    return F.concat_ws("_", F.lit("tile"), col, row)


def parse_tile_id(tile: Column) -> tuple[Column, Column]:
    parts = F.split(tile, "_")
    return parts[1].cast("int"), parts[2].cast("int")


def tile_key(tile: Column, year: Column, dob: Column) -> Column:
    """Key of a tile-day: ``tile_c_r_DOB_yyyy_ddd``."""
    return F.concat(tile, F.lit("_DOB_"), year.cast("string"), F.lit("_"), dob.cast("string"))


TILE_KEY_PATTERN = r"^(tile_(-?\d+)_(-?\d+))_DOB_(\d+)_(\d+)$"


def parse_tile_key(key: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(key, TILE_KEY_PATTERN, i)
    return {
        "tile_id": part(1),
        "tile_col": part(2).cast("int"),
        "tile_row": part(3).cast("int"),
        "year": part(4).cast("int"),
        "dob": part(5).cast("int"),
    }


def day_key(fireday: Column | str) -> Column:
    return F.format_string("day_%03d", F.col(fireday) if isinstance(fireday, str) else fireday)


def tile_bounds(
    col: Column, row: Column, grid: int = k.GRID_SIZE, pixel: float = k.PIXEL_SIZE
) -> dict[str, Column]:
    span = F.lit(float(grid * pixel))
    return {
        "min_x": col * span,
        "max_x": (col + 1) * span,
        "min_y": row * span,
        "max_y": (row + 1) * span,
    }


def cell_origin(
    col: Column, row: Column, pixel_x: Column, pixel_y: Column,
    grid: int = k.GRID_SIZE, pixel: float = k.PIXEL_SIZE,
) -> tuple[Column, Column]:
    """Left/top corner of a lattice cell in metres."""
    bounds = tile_bounds(col, row, grid, pixel)
    return bounds["min_x"] + pixel_x * F.lit(float(pixel)), bounds["max_y"] - pixel_y * F.lit(float(pixel))


def snap_index(value: Column, origin: float, step: float) -> Column:
    """Index of the nearest node of a regular axis; an equi-join key for nearest-cell lookups."""
    return F.floor((value - F.lit(origin)) / F.lit(step) + F.lit(0.5)).cast("bigint")


def centre_index(value: Column, origin: float, per_unit: float, direction: int = 1) -> Column:
    """Index of the cell whose centre is nearest on an edge-anchored axis."""
    return F.floor((value - F.lit(origin)) * F.lit(direction * per_unit)).cast("bigint")


def clamp(index: Column, low: Column | int, high: Column | int) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(index, as_col(low)), as_col(high))


def fire_size(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Extent of a fire in square degrees, padded so that a point has an area."""
    return (max_lat - min_lat + 1e-5) * (max_lon - min_lon + 1e-5)
