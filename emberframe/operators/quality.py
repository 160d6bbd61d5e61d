"""Quality mask and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_bad(features: list[str]) -> Column:
    """A pixel is bad when any checked feature is missing or not finite."""
    bad = F.lit(False)
    for name in features:
        v = F.col(name)
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return bad


def quality_mask(pixels: DataFrame, features: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Bad pixels only; a clean tile-day has no rows.

    A feature absent from the whole tile-day is NULL in all its pixels, which marks them all.
    """
    return pixels.where(is_bad(features)).select(*keys, "pixel_y", "pixel_x")


def tile_day_quality(pixels: DataFrame, features: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Pixels and bad pixels per tile-day."""
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("pixels"), F.count_if(is_bad(features)).alias("bad_pixels")
    )


def quality_summary(per_day: DataFrame) -> DataFrame:
    return per_day.agg(
        F.count_if(F.col("bad_pixels") == 0).alias("clean_days"),
        F.count_if(F.col("bad_pixels") > 0).alias("problem_days"),
    )
