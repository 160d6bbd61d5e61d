"""Satellite scenes: catalogue search, mosaics and tiered selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe import constants as k

SCENE_DAY = ("tile_no", "acq_date")


def search_catalogue(
    tiles: DataFrame, footprints: DataFrame, buffer_deg: float = 0.1, cell_deg: float = 0.5,
    lookback_days: int = k.LOOKBACK_DAYS,
) -> DataFrame:
    """Scenes whose footprint meets a tile's box (plus buffer) within the tile's date window.

    Boxes are cut into coarse cells and months, which makes the overlap test an equi-join with a
    residual.  A pair is reported only in the cell holding the lower corner of the common part,
    so no distinct is needed.
    """
    cell = lambda c: F.floor(c / F.lit(cell_deg))
    month = lambda d: F.year(d) * 12 + F.month(d)
    box = tiles.withColumns(
        {
            "t_lon0": F.col("min_lon") - buffer_deg, "t_lon1": F.col("max_lon") + buffer_deg,
            "t_lat0": F.col("min_lat") - buffer_deg, "t_lat1": F.col("max_lat") + buffer_deg,
            "from_date": F.date_add("first_date", 1 - lookback_days), "to_date": F.date_add("last_date", 2),
        }
    )
    left = (
        box.withColumn("_cx", F.explode(F.sequence(cell(F.col("t_lon0")), cell(F.col("t_lon1")))))
        .withColumn("_cy", F.explode(F.sequence(cell(F.col("t_lat0")), cell(F.col("t_lat1")))))
        .withColumn("_m", F.explode(F.sequence(month(F.col("from_date")), month(F.col("to_date")))))
    )
    right = footprints.select(
        "scene_id", "acq_date", F.col("min_lon").alias("s_lon0"), F.col("max_lon").alias("s_lon1"),
        F.col("min_lat").alias("s_lat0"), F.col("max_lat").alias("s_lat1"),
    )
    right = (
        right.withColumn("_cx", F.explode(F.sequence(cell(F.col("s_lon0")), cell(F.col("s_lon1")))))
        .withColumn("_cy", F.explode(F.sequence(cell(F.col("s_lat0")), cell(F.col("s_lat1")))))
        .withColumn("_m", month(F.col("acq_date")))
    )
    low_x, low_y = F.greatest("t_lon0", "s_lon0"), F.greatest("t_lat0", "s_lat0")
    hit = (
        (low_x <= F.least("t_lon1", "s_lon1"))
        & (low_y <= F.least("t_lat1", "s_lat1"))
        & F.col("acq_date").between(F.col("from_date"), F.col("to_date"))
        & (F.col("_cx") == cell(low_x))
        & (F.col("_cy") == cell(low_y))
    )
    return left.join(right, ["_cx", "_cy", "_m"]).where(hit).select(*tiles.columns, "scene_id", "acq_date")


def scenes_in_lookback(days: DataFrame, scenes: DataFrame, max_cloud: float = 100.0, lookback_days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """Tile-days with the scenes of the last 30 days, cloud at most ``max_cloud``.

    Both sides carry a 30-day bucket, so a busy tile is spread over its buckets and the range
    condition is a residual of an equi-join.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(lookback_days))
    first = F.date_add("burn_date", 1 - lookback_days)
    left = days.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(first), bucket(F.col("burn_date"))))))
    right = scenes.where(F.coalesce("cloud_cover", F.lit(100.0)) <= max_cloud).withColumn("_b", bucket(F.col("acq_date")))
    lookback = F.datediff("burn_date", "acq_date")
    return (
        left.join(right, ["tile_no", "_b"])
        .withColumn("lookback", lookback)
        .where(F.col("lookback").between(0, lookback_days - 1))
        .drop("_b")
    )


def daily_mosaic(scenes: DataFrame, pixels: DataFrame) -> DataFrame:
    """First known value per tile, day, band and pixel, taking scenes from clear to cloudy.

    ``cloud`` is the cloud cover at which the pixel gets filled; a pixel no scene fills stays NULL.
    Equally cloudy scenes keep the order of their ids. The rank is attached to the scene rows and compared inside the
    aggregate, which combines before the shuffle: pixels are never sorted by cloud. Pixels often come from an explode, whose size
    the planner takes for that of its input, so neither side may be broadcast.
    """
    cloud = F.coalesce("cloud_cover", F.lit(100.0))
    clear_first = Window.partitionBy(*SCENE_DAY).orderBy("cloud_cover", "scene_id")  # scenes of a day, not pixels
    ordered = scenes.select("scene_id", *SCENE_DAY, cloud.alias("cloud_cover")).withColumn("scene_order", F.row_number().over(clear_first))
    known = F.col("value").isNotNull()
    return (
        pixels.join(ordered.hint("merge"), "scene_id")
        .groupBy(*SCENE_DAY, "band", "pixel")
        .agg(
            F.min_by("value", F.when(known, F.col("scene_order"))).alias("value"),
            F.min(F.when(known, F.col("cloud_cover"))).alias("cloud"),
        )
    )


def tier_of(cloud: Column, tiers: tuple[float, ...] = k.CLOUD_TIERS) -> Column:
    """Smallest threshold index that admits a cloud cover; NULL above the last."""
    out: Column = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers))):
        out = F.when(cloud <= t, F.lit(i)).otherwise(out)
    return out


def accepted_days(mosaic: DataFrame, scl_band: object = k.SCL_BAND, tiers: tuple[float, ...] = k.CLOUD_TIERS) -> DataFrame:
    """Lowest tier at which the mosaic of a tile and day is complete and not all zero.

    Admitting cloudier scenes never changes a filled pixel, so a day accepted at one tier is
    accepted at every higher one: one number per day replaces a test per tier and look-back.
    """
    return (
        mosaic.where(F.col("band") != F.lit(scl_band))
        .groupBy(*SCENE_DAY)
        .agg(
            F.bool_and(F.col("value").isNotNull()).alias("complete"),
            F.bool_or(F.coalesce(F.col("value") != 0, F.lit(False))).alias("any_signal"),
            F.max("cloud").alias("cloud_needed"),
        )
        .where("complete AND any_signal")
        .withColumn("tier", tier_of(F.col("cloud_needed"), tiers))
        .where(F.col("tier").isNotNull())
        .select(*SCENE_DAY, "tier", "cloud_needed")
    )


def choose_day(days: DataFrame, accepted: DataFrame, lookback_days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """Per tile-day the accepted acquisition of the lowest tier, most recent within the tier.

    Tier and look-back are packed into one integer, so the choice is a plain minimum.
    """
    candidates = scenes_in_lookback(days, accepted.withColumn("cloud_cover", F.lit(0.0)), lookback_days=lookback_days)
    best = candidates.groupBy(*days.columns).agg(
        F.min(F.col("tier") * lookback_days + F.col("lookback")).alias("_best")
    )
    lookback = (F.col("_best") % lookback_days).cast("int")
    return best.select(
        *days.columns,
        F.floor(F.col("_best") / lookback_days).cast("int").alias("tier"),
        lookback.alias("lookback"),
        F.date_sub("burn_date", lookback).alias("acq_date"),
    )


def chosen_mosaic(chosen: DataFrame, mosaic: DataFrame, tiers: tuple[float, ...] = k.CLOUD_TIERS) -> DataFrame:
    """Pixels of the chosen day; values filled only above the chosen tier are dropped to NULL."""
    limit = F.element_at(F.array(*[F.lit(t) for t in tiers]), F.col("tier") + 1)
    joined = chosen.join(mosaic, list(SCENE_DAY))
    return joined.withColumn("value", F.when(F.col("cloud") <= limit, F.col("value")))


def band_columns(chosen_pixels: DataFrame, keys: tuple[str, ...], bands: dict[str, object]) -> DataFrame:
    """Band-long pixels to one column per channel (``{"s2_b02": "B02", ...}``); a fixed list, so one pass."""
    return chosen_pixels.groupBy(*keys).agg(
        *[F.max(F.when(F.col("band") == F.lit(b), F.col("value"))).alias(c) for c, b in bands.items()]
    )


def provenance(mosaic: DataFrame, band: object = 0) -> DataFrame:
    """Share of pixels per cloud cover in the first band of each tile and day."""
    first = mosaic.where((F.col("band") == F.lit(band)) & F.col("cloud").isNotNull())
    per_cloud = first.groupBy(*SCENE_DAY, "cloud").agg(F.count("*").alias("n"))
    total = mosaic.where(F.col("band") == F.lit(band)).groupBy(*SCENE_DAY).agg(F.count("*").alias("total"))
    return per_cloud.join(total, list(SCENE_DAY)).select(
        *SCENE_DAY,
        F.round(F.col("n") / F.col("total") * 100, 2).alias("pixels_pct"),
        F.round("cloud", 2).alias("cloud_cover_pct"),
    )


def provenance_list(shares: DataFrame) -> DataFrame:
    """Array form of the provenance, one row per tile and day (at most one entry per scene)."""
    entry = F.struct("pixels_pct", "cloud_cover_pct", F.col("acq_date").cast("string").alias("acquisition_date"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("cloud_cover_pct").alias("o"), entry.alias("e"))))
    return shares.groupBy(*SCENE_DAY).agg(F.transform(ordered, lambda s: s["e"]).alias("stats"))
