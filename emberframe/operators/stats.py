"""Normalisation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions.values import valid_or_null, zscore, zscore_or_zero


def feature_stats(pixels: DataFrame, features: list[str], nodata: float | None = None) -> DataFrame:
    """Mean, population deviation (+1e-8), range and count of each feature in one pass.

    All features aggregate side by side over the wide rows; the single result row is unpivoted,
    not the data.  Partial sums merge, so the result does not depend on the partitioning.
    """
    aggs = []
    for name in features:
        v = valid_or_null(F.col(name).cast("double"), nodata)
        aggs += [
            F.avg(v).alias(f"{name}|mean"), F.stddev_pop(v).alias(f"{name}|std"),
            F.min(v).alias(f"{name}|min"), F.max(v).alias(f"{name}|max"), F.count(v).alias(f"{name}|count"),
        ]
    row = pixels.agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"), F.col(f"{n}|mean").alias("mean"), (F.col(f"{n}|std") + 1e-8).alias("std"),
                F.col(f"{n}|min").alias("min"), F.col(f"{n}|max").alias("max"), F.col(f"{n}|count").alias("count"),
            )
            for n in features
        ]
    )
    return row.select(F.explode(entries).alias("s")).select("s.*").where(F.col("count") > 0)


def training_stats(
    dynamics: DataFrame, statics: DataFrame, train_days: DataFrame, clean_days: DataFrame,
    day_keys: list[str], tile_keys: list[str], dynamic_features: list[str], static_features: list[str],
) -> DataFrame:
    """Statistics over clean training tile-days; statics once per tile, vegetation left out."""
    days = train_days.select(*day_keys).distinct().join(clean_days.select(*day_keys), day_keys, "left_semi")
    used = [f for f in dynamic_features if f not in k.UNNORMALISED]
    moving = feature_stats(dynamics.join(days, day_keys, "left_semi"), used)
    fixed_tiles = days.select(*tile_keys).distinct()
    fixed = feature_stats(statics.join(fixed_tiles, tile_keys, "left_semi"), static_features, k.TERRAIN_NODATA)
    return moving.unionByName(fixed)


def _lookup(stats: DataFrame) -> Column:
    """All statistics as one map value (one entry per feature)."""
    entry = F.struct("feature", F.struct("mean", "std"))
    return stats.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def normalise(pixels: DataFrame, stats: DataFrame, dynamics: list[str], statics: list[str]) -> DataFrame:
    """Z-score the given features; unknown dynamics become 0, unknown statics stay NULL."""
    tagged = pixels.withColumn("_stats", _lookup(stats))

    def scaled(name: str, fn) -> Column:
        entry = F.try_element_at("_stats", F.lit(name))
        return fn(F.col(name), entry["mean"], entry["std"])

    columns = {n: scaled(n, zscore_or_zero) for n in dynamics if n not in k.UNNORMALISED}
    columns |= {n: F.coalesce(F.col(n), F.lit(0.0)) for n in dynamics if n in k.UNNORMALISED}
    columns |= {n: scaled(n, zscore) for n in statics}
    return tagged.withColumns(columns).drop("_stats")
