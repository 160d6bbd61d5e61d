"""Rasters as strips: one row per tile-day and pixel row, each channel an array over its columns.

A tile-day has 256 rows instead of 65 536, so dense stencils and samples shuffle whole rows of pixels; neighbours in x
are positions in an array, neighbours in y the strips before and after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.operators.tiles import TILE_DAY


def scaffold(tile_days: DataFrame, keys: tuple[str, ...] = TILE_DAY, grid: int = k.GRID_SIZE) -> DataFrame:
    """The ``grid`` empty strips of every tile-day."""
    return tile_days.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("pixel_y"))


def fill(
    strips: DataFrame, cells: DataFrame, values: dict[str, object], keys: tuple[str, ...] = TILE_DAY, grid: int = k.GRID_SIZE
) -> DataFrame:
    """Add a channel per column of ``values`` (name to default) from cells, at most one per pixel; missing and NULL cells take the default.

    Cells fold to a strip's arrays before they meet the scaffold, so rows of pixels are shuffled, not entries; a sparse strip is its
    cells in order, each with the gap up to the next. Defaults take the type of the column.
    """
    entry = F.struct("pixel_x", *values)
    held = cells.groupBy(*keys, "pixel_y").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    other = {name: F.lit(default).cast(cells.schema[name].dataType) for name, default in values.items()}
    after = lambda i: F.coalesce(F.get("_e", i + 1)["pixel_x"], F.lit(grid))

    def row(name: str) -> Column:
        value = lambda e: F.coalesce(e[name], other[name])
        spaced = F.transform("_e", lambda e, i: F.concat(F.array(value(e)), F.array_repeat(other[name], after(i) - e["pixel_x"] - 1)))
        sparse = F.concat(F.array_repeat(other[name], F.col("_e")[0]["pixel_x"]), F.flatten(spaced))
        return F.when(F.size("_e") == grid, F.transform("_e", value)).otherwise(sparse)

    held = held.select(*keys, "pixel_y", *[row(name).alias(name) for name in values])
    out = strips.join(held, [*keys, "pixel_y"], "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.array_repeat(other[name], grid)) for name in values})


def gather(
    cells: DataFrame, word: Column, channels: dict[str, Callable[[Column], Column]], keys: tuple[str, ...] = TILE_DAY, grid: int = k.GRID_SIZE
) -> DataFrame:
    """Strips from cells and from rows without ``pixel_x`` that name the strips to make; cells of other strips are left out.

    ``word``: what a cell holds, from 0 (as in missing cells) to 2^40 - 1, so that entries are sorted as plain numbers;
    ``channels`` read it. Unlike ``scaffold`` and ``fill`` this has no join: cells dealt by (part of) ``keys`` become
    strips where they lie, and nothing dense is shuffled.
    """
    entry = F.when(F.col("pixel_x").isNotNull(), F.col("pixel_x").cast("bigint") * F.lit(1 << 40) + word)
    held = cells.groupBy(*keys, "pixel_y").agg(F.sort_array(F.collect_list(entry)).alias("_e"), F.max(F.col("pixel_x").isNull()).alias("_named"))
    value = lambda e: e.bitwiseAND(F.lit((1 << 40) - 1))
    column = lambda e: F.shiftright(e, 40).cast("int")
    none = F.lit(0).cast("bigint")
    after = lambda i: F.coalesce(column(F.get("_e", i + 1)), F.lit(grid))
    spaced = F.flatten(F.transform("_e", lambda e, i: F.concat(F.array(value(e)), F.array_repeat(none, after(i) - column(e) - 1))))
    sparse = F.concat(F.array_repeat(none, column(F.get("_e", F.lit(0)))), spaced)
    words = F.when(F.size("_e") == grid, F.transform("_e", value)).when(F.size("_e") > 0, sparse)
    held = held.where("_named").select(*keys, "pixel_y", words.alias("_w"))
    made = {name: F.coalesce(F.transform("_w", read), F.array_repeat(read(none), grid)) for name, read in channels.items()}
    return held.select(*keys, "pixel_y", *[row.alias(name) for name, row in made.items()])


def shift(row: Column, by: int, outside: Column) -> Column:
    """The value ``by`` columns to the right of each column; ``outside`` beyond the tile."""
    if by == 0:
        return row
    edge = F.array_repeat(outside, F.least(F.lit(abs(by)), F.size(row)))
    if by > 0:
        return F.concat(F.slice(row, F.lit(by + 1), F.greatest(F.size(row) - by, F.lit(0))), edge)
    return F.concat(edge, F.slice(row, F.lit(1), F.greatest(F.size(row) + by, F.lit(0))))


def _rows_around(channel: str, radius: int, keys: tuple[str, ...], beyond: Column) -> list[Column]:
    """The strips from ``radius`` above to ``radius`` below; ``beyond`` stands for strips beyond the tile."""
    spec = Window.partitionBy(*keys).orderBy("pixel_y")  # the strips of one tile-day
    moved = lambda d: F.lag(channel, -d).over(spec) if d < 0 else F.lead(channel, d).over(spec)
    return [F.col(channel) if d == 0 else F.coalesce(moved(d), beyond) for d in range(-radius, radius + 1)]


def window(
    strips: DataFrame, channel: str, out: str, combine: Callable[[Column, Column], Column], outside: object,
    radius: int = 1, keys: tuple[str, ...] = TILE_DAY,
) -> DataFrame:
    """``out``: all cells of the square around each cell folded by an associative ``combine`` (sum, greatest, least).

    Rows first, then the folded rows above and below: 4 * radius array operations a strip. ``combine`` must keep
    the type, and leave ``outside`` as it is when both sides are ``outside``; strips of nothing else then pass by unread.
    """
    none = F.lit(outside).cast(strips.schema[channel].dataType.elementType)
    fold = lambda a, b: combine(a, b)
    bare = F.size(F.array_remove(channel, none)) == 0
    row = F.col(channel)
    for d in range(1, radius + 1):
        for by in (-d, d):
            row = F.zip_with(row, shift(F.col(channel), by, none), fold)
    # A strip of nothing else is NULL until the end, like one beyond the tile.
    folded = strips.withColumn("_row", F.when(~bare, row))
    rows = _rows_around("_row", radius, keys, F.lit(None))
    folded = folded.withColumns({f"_r{i}": r for i, r in enumerate(rows)})
    blank = F.array_repeat(none, F.size(channel))
    total = F.col("_r0")
    for i in range(1, len(rows)):
        some = total.isNotNull() | F.col(f"_r{i}").isNotNull()
        total = F.when(some, F.zip_with(F.coalesce(total, blank), F.coalesce(F.col(f"_r{i}"), blank), fold))
        folded = folded.withColumn("_total", total)
        total = F.col("_total")
    return folded.withColumn(out, F.coalesce(total, blank)).drop("_row", "_total", *[f"_r{i}" for i in range(len(rows))])


def patches(strips: DataFrame, channels: list[str], patch: int = 3, keys: tuple[str, ...] = TILE_DAY, out: str = "features") -> DataFrame:
    """``out``: per column of the strip the zero-padded patch around the cell: channel, then row, then column.

    Channels hold doubles; missing and infinite values are zero, as in ``stencil.extract_patches``.
    """
    if patch < 1 or patch % 2 == 0:
        raise ValueError("patch must be a positive odd number")
    radius, zero = patch // 2, F.lit(0.0)
    finite = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), zero).otherwise(v)
    pad = [F.array_repeat(zero, radius)] if radius else []
    around = strips.withColumns({f"_p_{c}": F.concat(*pad, F.transform(c, finite), *pad) for c in channels})
    rows = {f"_q_{c}_{i}": r for c in channels for i, r in enumerate(_rows_around(f"_p_{c}", radius, keys, F.array_repeat(zero, F.size(f"_p_{c}"))))}
    around = around.withColumns(rows)
    cut = lambda x: F.concat(*[F.slice(F.col(q), x + 1, F.lit(patch)) for q in rows])
    made = F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), cut)
    return around.withColumn(out, made).drop(*[f"_p_{c}" for c in channels], *rows)


def pack(strips: DataFrame, channels: list[str], keys: tuple[str, ...] = TILE_DAY) -> DataFrame:
    """One row per tile-day, each channel one array, row by row. A group is the strips of a tile-day."""
    held = strips.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pixel_y", *channels))).alias("_s"))
    return held.select(*keys, *[F.flatten(F.col("_s")[c]).alias(c) for c in channels])
