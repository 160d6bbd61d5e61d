"""Samples as arrays: gate, training statistics, channels, labels, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.operators import burn, channels, pairing, quality, stats
from emberframe.operators.tiles import PIXEL, TILE, TILE_DAY
from emberframe.plans import sample_build
from emberframe.session import cut_lineage


def bad_days(environment: DataFrame, statics: DataFrame) -> DataFrame:
    """Tile-days with a bad pixel in any checked layer; a bad static pixel marks all days of its tile."""
    moving = environment.where(quality.is_bad(list(k.QUALITY_DYNAMIC))).select(*TILE_DAY).distinct()
    fixed = statics.where(quality.is_bad(list(k.QUALITY_STATIC))).select(*TILE).distinct()
    return moving.unionByName(environment.select(*TILE_DAY).distinct().join(fixed, list(TILE), "left_semi")).distinct()


def day_channels(
    index: sample_build.SampleIndex, environment: DataFrame, statics: DataFrame, gate: DataFrame, days: DataFrame,
    scl_scale: float = 1e-4, history: bool = True, transform: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Channel rows of the wanted ``days``, normalised with statistics of clean training days only.

    ``transform`` is applied to the finished rows, one per pixel.
    """
    clean = pairing.pass_gate(sample_build.split_days(index.fires), gate, TILE_DAY)
    train = sample_build.split_days(index.fires).where("split = 'train'")
    table = cut_lineage(stats.training_stats(
        environment, statics, train, clean, list(TILE_DAY), list(TILE), list(k.DYNAMIC_FEATURES), list(k.STATIC_FEATURES)
    ), "training-stats")
    wanted = days.select(*TILE_DAY).distinct()
    fires = index.fires.drop("split").join(wanted, list(TILE_DAY), "left_semi")
    masks = burn.current_mask(fires, index.masks, history)
    rows = channels.assemble_channels(
        environment.join(wanted, list(TILE_DAY), "left_semi"), statics, masks, table, TILE_DAY, TILE, scl_scale
    )
    return rows if transform is None else rows.transform(transform)


def samples(
    index: sample_build.SampleIndex, environment: DataFrame, statics: DataFrame, gate: DataFrame, delta_t: DataFrame,
    classes: int = 2, **options,
) -> DataFrame:
    """One row per next-day sample: keys, split, delta_t, ``x`` (channel by channel) and ``y``.

    ``environment`` is dense per tile-day, ``statics`` per tile, ``delta_t`` (tile-day, days) the age of the imagery.
    """
    rows = day_channels(index, environment, statics, gate, index.pairs, **options)
    labels = sample_build.next_day_labels(index, classes, options.get("history", True)).select(*TILE_DAY, *PIXEL, "label")
    keyed = index.pairs.select(*TILE_DAY, "split").join(delta_t.select(*TILE_DAY, "delta_t"), list(TILE_DAY), "left")
    keyed = keyed.withColumn("delta_t", F.coalesce("delta_t", F.lit(0)).cast("smallint"))
    labelled = rows.join(labels, [*TILE_DAY, *PIXEL], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    packed = channels.pack(labelled, TILE_DAY, label="label")
    return packed.join(keyed, list(TILE_DAY))


def sequences(
    index: sample_build.SampleIndex, environment: DataFrame, statics: DataFrame, gate: DataFrame, n: int = 3, classes: int = 2, **options,
) -> DataFrame:
    """One row per sequence: keys, split, positions, ``x`` (steps of ``step``, ``x``) and ``y`` of the last growth.

    Channels are assembled and packed once per tile-day, however many sequences use the day.
    """
    starts = cut_lineage(sample_build.sequence_samples(index, n, gate), "sequences")
    steps = pairing.sequence_steps(starts.select("year", *TILE, "start_dob", "split", "positions"), n)
    packed = channels.pack(day_channels(index, environment, statics, gate, steps, **options), TILE_DAY)
    frames = steps.join(packed, list(TILE_DAY)).groupBy("year", *TILE, "start_dob", "split", "positions").agg(
        F.array_sort(F.collect_list(F.struct("step", "x"))).alias("x")
    )  # n frames
    labels = sample_build.sequence_labels(index, starts, n, classes, options.get("history", True))
    found = labels.groupBy("year", *TILE, "start_dob").agg(F.array_sort(F.collect_list(F.struct(*PIXEL, "label"))).alias("y"))
    return frames.join(found, ["year", *TILE, "start_dob"], "left")
