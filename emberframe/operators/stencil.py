"""Neighbourhood operators on pixel tables.

Two families.  Dense grids (every cell of a tile present, see ``tiles.dense_scaffold``) use
``lag``/``lead`` windows after one shuffle by tile: both window passes cluster on a superset of
that key, so Spark adds no further exchange, whatever the stencil size.  Sparse masks (burned
pixels only) push each pixel to its neighbours and count arrivals, so their cost follows the
burned area rather than the 65 536 cells of a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe import constants as k

KEYS = ("tile", "day")
CELLS_AT_ONCE = 1 << 19  # burned cells whose holes are labelled together, about


def by_tile(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The only shuffle of a dense stencil; a tile-day has at most grid**2 rows."""
    return cells.repartition(*keys)


def _line(keys: tuple[str, ...], fixed: str, moving: str):
    return Window.partitionBy(*keys, fixed).orderBy(moving)


def _shift(column: str, by: int, spec) -> Column:
    return F.col(column) if by == 0 else F.lead(column, by).over(spec) if by > 0 else F.lag(column, -by).over(spec)


def offset_name(channel: str, dy: int, dx: int) -> str:
    side = lambda d: f"m{-d}" if d < 0 else f"p{d}"
    return f"{channel}_{side(dy)}_{side(dx)}"


def neighbours(cells: DataFrame, channels: list[str], radius: int, keys: tuple[str, ...]) -> DataFrame:
    """Add a column per channel and offset with the neighbour's value (NULL outside the tile)."""
    out = by_tile(cells, keys)
    along_x, along_y = _line(keys, "pixel_y", "pixel_x"), _line(keys, "pixel_x", "pixel_y")
    steps = range(-radius, radius + 1)
    out = out.withColumns({f"_x{i}_{c}": _shift(c, d, along_x) for c in channels for i, d in enumerate(steps)})
    out = out.withColumns(
        {
            offset_name(c, dy, dx): _shift(f"_x{i}_{c}", dy, along_y)
            for c in channels for dy in steps for i, dx in enumerate(steps)
        }
    )
    return out.drop(*[f"_x{i}_{c}" for c in channels for i in range(len(steps))])


def patch_columns(channels: list[str], patch: int) -> list[str]:
    """Feature order of a patch: channel, then row, then column."""
    if patch < 1 or patch % 2 == 0:
        raise ValueError("patch must be a positive odd number")
    r = range(-(patch // 2), patch // 2 + 1)
    return [offset_name(c, dy, dx) for c in channels for dy in r for dx in r]


def extract_patches(cells: DataFrame, channels: list[str], patch: int, keys: tuple[str, ...]) -> DataFrame:
    """``features``: the zero-padded patch around every cell as one array."""
    names = patch_columns(channels, patch)
    around = neighbours(cells, channels, patch // 2, keys)
    clean = [_finite(F.col(n)) for n in names]
    return around.withColumn("features", F.array(*clean)).drop(*names)


def _finite(v: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def _extreme(agg, value: str, spec) -> Column:
    return agg(value).over(spec.rowsBetween(-1, 1))


def close_dense(cells: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Grey closing with a 3x3 window (maximum, then minimum); cells outside the tile are ignored."""
    along_x, along_y = _line(keys, "pixel_y", "pixel_x"), _line(keys, "pixel_x", "pixel_y")
    out = by_tile(cells, keys)
    out = out.withColumn("_c", _extreme(F.max, value, along_x)).withColumn("_c", _extreme(F.max, "_c", along_y))
    out = out.withColumn("_c", _extreme(F.min, "_c", along_y)).withColumn("_c", _extreme(F.min, "_c", along_x))
    return out.withColumn(value, F.col("_c")).drop("_c")


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in pairs]))


SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def push_to_neighbours(pixels: DataFrame, offsets: list[tuple[int, int]], grid: int = k.GRID_SIZE) -> DataFrame:
    """Each pixel once per neighbour inside the tile, under the neighbour's coordinates."""
    moved = pixels.withColumn("_o", _offsets(offsets)).withColumns(
        {"pixel_y": F.col("pixel_y") + F.col("_o.dy"), "pixel_x": F.col("pixel_x") + F.col("_o.dx")}
    )
    inside = F.col("pixel_y").between(0, grid - 1) & F.col("pixel_x").between(0, grid - 1)
    return moved.where(inside).drop("_o")


def _in_grid(offsets: list[tuple[int, int]], grid: int) -> Column:
    """How many of the offsets stay inside the tile at this cell."""
    total: Column = F.lit(0)
    for dy, dx in offsets:
        ok = (F.col("pixel_y") + dy).between(0, grid - 1) & (F.col("pixel_x") + dx).between(0, grid - 1)
        total = total + ok.cast("int")
    return total


def dilate(mask: DataFrame, keys: tuple[str, ...], grid: int = k.GRID_SIZE) -> DataFrame:
    cells = [*keys, "pixel_y", "pixel_x"]
    return push_to_neighbours(mask.select(*cells), SQUARE, grid).distinct()


def erode(mask: DataFrame, keys: tuple[str, ...], grid: int = k.GRID_SIZE) -> DataFrame:
    """Pixels whose whole in-tile neighbourhood is set: arrivals equal the neighbourhood's size."""
    cells = [*keys, "pixel_y", "pixel_x"]
    arrivals = push_to_neighbours(mask.select(*cells), SQUARE, grid).groupBy(*cells).agg(F.count("*").alias("_n"))
    return arrivals.where(F.col("_n") == _in_grid(SQUARE, grid)).select(*cells)


def close_mask(mask: DataFrame, keys: tuple[str, ...], grid: int = k.GRID_SIZE) -> DataFrame:
    """Binary closing of a sparse mask (unique pixels)."""
    return erode(dilate(mask, keys, grid), keys, grid)


def fill_holes(mask: DataFrame, keys: tuple[str, ...], max_size: int = 1, grid: int = k.GRID_SIZE) -> DataFrame:
    """Add 4-connected background components of at most ``max_size`` cells to a sparse mask.

    ``max_size=1`` needs one exchange: a background cell is filled when all its in-tile
    4-neighbours are burned.  Larger holes need one too: the cells of a tile-day meet as one list (at most grid**2 numbers),
    and only background within ``max_size`` steps of the mask is labelled; a part of it that goes on further is too large.
    """
    cells = [*keys, "pixel_y", "pixel_x"]
    mask = mask.select(*cells)
    if max_size < 1:
        return mask
    if max_size == 1:
        arrivals = push_to_neighbours(mask, CROSS, grid).groupBy(*cells).agg(F.count("*").alias("_n"))
        holes = arrivals.where(F.col("_n") == _in_grid(CROSS, grid)).select(*cells).join(mask, cells, "left_anti")
        return mask.unionByName(holes)
    place = (F.col("pixel_y") * grid + F.col("pixel_x")).cast("int")
    packed = mask.groupBy(*keys).agg(F.collect_list(place).alias("_cells"))
    kinds = [f"`{c}` {mask.schema[c].dataType.simpleString()}" for c in keys]
    found = packed.mapInArrow(_small_holes(max_size, grid), ", ".join([*kinds, "_hole int"]))
    at = {"pixel_y": F.floor(F.col("_hole") / grid), "pixel_x": F.col("_hole") % grid}
    holes = found.select(*keys, *[c.cast(mask.schema[n].dataType).alias(n) for n, c in at.items()])
    return mask.unionByName(holes)


def _small_holes(max_size: int, grid: int):
    """Rows of a tile-day's burned cells (``_cells``: y * grid + x) to rows of the cells of its small holes (``_hole``)."""
    wide = grid + 2  # a rim on all sides
    moves = (-wide, -1, 1, wide)

    def inside(code: np.ndarray) -> np.ndarray:
        y, x = code % (wide * wide) // wide, code % wide
        return (y >= 1) & (y <= grid) & (x >= 1) & (x <= grid)

    def holes(burned: np.ndarray) -> np.ndarray:
        near = np.zeros(0, np.int64)
        edge = burned
        for _ in range(max_size):
            edge = np.unique(np.concatenate([edge + m for m in moves]))
            edge = edge[inside(edge)]
            edge = np.setdiff1d(np.setdiff1d(edge, burned, assume_unique=True), near, assume_unique=True)
            near = np.union1d(near, edge)
        if not len(near):
            return near
        met = []
        for m in moves:
            at = np.minimum(np.searchsorted(near, near + m), len(near) - 1)
            met.append((at, near[at] == near + m))
        label = np.arange(len(near))
        for _ in range(max_size - 1):  # a component of max_size cells has one label by then
            label = np.minimum.reduce([label, *[np.where(hit, label[at], label) for at, hit in met]])
        large = np.zeros(len(near), bool)
        for (at, hit), m in zip(met, moves):
            beyond = ~hit & inside(near + m) & ~np.isin(near + m, burned)
            large[label[beyond | (hit & (label[at] != label))]] = True
        large |= np.bincount(label, minlength=len(near)) > max_size
        return near[~large[label]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_cells")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            first = 0
            while first < len(batch):
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + CELLS_AT_ONCE, side="right")))
                part = lists.slice(first, last - first)
                cells = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(last - first), part.value_lengths().to_numpy(zero_copy_only=False))
                found = holes(np.unique(row * (wide * wide) + (cells // grid + 1) * wide + cells % grid + 1))
                row, place = found // (wide * wide) + first, found % (wide * wide)
                cell = (place // wide - 1) * grid + place % wide - 1
                keys = [c for c in batch.schema.names if c != "_cells"]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(row)) for c in keys], pa.array(cell.astype(np.int32))], names=[*keys, "_hole"]
                )
                first = last

    return run


def pool(cells: DataFrame, factor: int, keys: tuple[str, ...], aggs: dict[str, Column], grid: int | None = None) -> DataFrame:
    """Coarser lattice: one row per ``factor x factor`` block; with ``grid`` the cells beyond the last whole block drop out."""
    if grid is not None:
        whole = grid // factor * factor
        cells = cells.where((F.col("pixel_y") < whole) & (F.col("pixel_x") < whole))
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy(*keys, block("pixel_y"), block("pixel_x")).agg(*[a.alias(n) for n, a in aggs.items()])


def max_pool(cells: DataFrame, value: str, keys: tuple[str, ...], factor: int = 2, grid: int = k.GRID_SIZE) -> DataFrame:
    return pool(cells, factor, keys, {value: F.max(value)}, grid)


def average_resample(cells: DataFrame, value: str, keys: tuple[str, ...], factor: int) -> DataFrame:
    return pool(cells, factor, keys, {value: F.avg(value)})


def _gradients(cells: DataFrame, dem: str, keys: tuple[str, ...], grid: int) -> tuple[DataFrame, Column, Column]:
    around = neighbours(cells, [dem], 1, keys)
    raw = lambda dy, dx: F.col(offset_name(dem, dy, dx)) if (dy, dx) != (0, 0) else F.col(dem)
    y, x, last = F.col("pixel_y"), F.col("pixel_x"), grid - 1

    def at(dy: int, dx: int) -> Column:
        """Outside the tile the first two rows (columns) go on in a straight line; in the first and last row a column outside
        repeats the edge column. A missing height takes the centre's."""
        value = raw(dy, dx)
        if dx:
            side = x == (0 if dx < 0 else last)
            value = F.when(side, 2 * raw(dy, 0) - raw(dy, -dx)).otherwise(value)
            border = F.when(side, raw(dy, 0)).otherwise(raw(dy, dx))
            value = F.when((y == 0) | (y == last), border).otherwise(value)
        if dy:
            column = lambda d: F.when(x == (0 if dx < 0 else last), raw(d, 0)).otherwise(raw(d, dx)) if dx else raw(d, 0)
            value = F.when(y == (0 if dy < 0 else last), 2 * column(0) - column(-dy)).otherwise(value)
        return F.coalesce(value, F.col(dem))

    west = at(-1, -1) + 2 * at(0, -1) + at(1, -1)
    east = at(-1, 1) + 2 * at(0, 1) + at(1, 1)
    north = at(-1, -1) + 2 * at(-1, 0) + at(-1, 1)
    south = at(1, -1) + 2 * at(1, 0) + at(1, 1)
    return around, east - west, south - north


def slope_aspect(
    cells: DataFrame, dem: str, keys: tuple[str, ...], pixel: float = k.PIXEL_SIZE, grid: int = k.GRID_SIZE
) -> DataFrame:
    """Horn slope (degrees) and compass aspect (degrees, 0 where flat) from one neighbourhood pass.

    Neighbours outside the tile of ``grid`` cells a side are extrapolated, others that are missing take the centre's height.
    """
    around, dx, dy = _gradients(cells, dem, keys, grid)
    slope = F.degrees(F.atan(F.hypot(dx, dy) / F.lit(8.0 * pixel)))
    angle = F.atan2(dy, -dx) * F.lit(180.0 / math.pi)
    compass = F.when(angle > 90, 450.0 - angle).otherwise(90.0 - angle)
    aspect = F.when((dx == 0) & (dy == 0), F.lit(0.0)).when(compass == 360.0, F.lit(0.0)).otherwise(compass)
    extra = [offset_name(dem, y, x) for y, x in SQUARE]
    return around.withColumns({"slope": slope, "aspect": aspect}).drop(*extra)


def crop_to_tile(cells: DataFrame, bounds: dict[str, Column], resolution: float) -> DataFrame:
    """DEM cells of a tile's box averaged to the tile lattice (``min_x..max_y`` columns or literals)."""
    inside = (
        (F.col("x") >= bounds["min_x"]) & (F.col("x") < bounds["max_x"])
        & (F.col("y") > bounds["min_y"]) & (F.col("y") <= bounds["max_y"])
    )
    return cells.where(inside).withColumns(
        {
            "pixel_x": F.floor((F.col("x") - bounds["min_x"]) / F.lit(resolution)).cast("int"),
            "pixel_y": F.floor((bounds["max_y"] - F.col("y")) / F.lit(resolution)).cast("int"),
        }
    )
