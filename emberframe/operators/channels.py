"""Assembly of the ordered sample channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions.values import cyclical, finite_or_null, scale_satellite
from emberframe.operators.stats import normalise
from emberframe.operators.tiles import PIXEL


def assemble_channels(
    environment: DataFrame, statics: DataFrame, masks: DataFrame, stats: DataFrame | None,
    day_keys: tuple[str, ...], tile_keys: tuple[str, ...],
    scl_scale: float = 1e-4, cyclical_aspect: bool = True, passthrough: tuple[str, ...] = (),
) -> DataFrame:
    """One row per pixel with the channels in storage order.

    ``environment``: dynamics per (day, pixel), dense; ``statics``: per (tile, pixel); ``masks``:
    sparse ``fireday_grid`` of burned pixels per (day, pixel).  Statistics are one map value, so
    normalising adds no join.  NULL dynamics become 0, NULL statics stay NULL.
    """
    joined = environment.join(statics, [*tile_keys, *PIXEL], "left").join(
        masks.select(*day_keys, *PIXEL, "fireday_grid", F.lit(1.0).alias("previous_burn_mask")),
        [*day_keys, *PIXEL], "left",
    )
    clean = joined.withColumns(
        {c: finite_or_null(F.col(c).cast("double")) for c in (*k.DYNAMIC_FEATURES, *k.STATIC_FEATURES)}
    )
    if cyclical_aspect:
        sin, cos = cyclical(F.col("aspect"))
        clean = clean.withColumns({"aspect_sin": sin, "aspect_cos": cos})
    scaled = clean.withColumns({c: scale_satellite(F.col(c), c, scl_scale) for c in k.SATELLITE_FEATURES})
    plain_statics = [c for c in k.STATIC_FEATURES if not (cyclical_aspect and c == "aspect")]
    if stats is not None:
        weather = list(k.WEATHER_FEATURES)
        scaled = normalise(scaled, stats, weather, plain_statics)
    scaled = scaled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in (*k.DYNAMIC_FEATURES, *k.MASK_CHANNELS)})
    order = k.CHANNELS if cyclical_aspect else k.DYNAMIC_FEATURES + k.STATIC_FEATURES + k.MASK_CHANNELS
    return scaled.select(*day_keys, *PIXEL, *passthrough, *order)


def pack(channels: DataFrame, keys: tuple[str, ...], names: tuple[str, ...] = k.CHANNELS, label: str | None = None) -> DataFrame:
    """Channel-major arrays per sample: the pixels of a tile-day, at most grid**2 of them."""
    columns = [F.array(*[F.col(c).cast("float") for c in names]).alias("v")]
    if label is not None:
        columns.append(F.col(label).cast("smallint").alias("y"))
    cell = F.struct("pixel_y", "pixel_x", *columns)
    packed = channels.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))

    def plane(i: int) -> Column:
        return F.transform("_cells", lambda c: F.element_at(c["v"], i + 1))

    out = [F.flatten(F.array(*[plane(i) for i in range(len(names))])).alias("x")]
    if label is not None:
        out.append(F.transform("_cells", lambda c: c["y"]).alias("y"))
    return packed.select(*keys, *out)
