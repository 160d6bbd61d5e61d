"""Tile-day index to split, labelled next-day and sequence samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.operators import burn, graph, pairing, split, tiles
from emberframe.operators.tiles import TILE, TILE_DAY
from emberframe.session import cut_lineage


@dataclass
class SampleIndex:
    """Everything later steps need; split is a column, so indexing happens once."""

    fires: DataFrame  # long tile-day index of the retained fires, with split
    members: DataFrame  # id, super_id
    pairs: DataFrame  # next-day samples with split
    masks: DataFrame  # burned pixels per fire day


def index_samples(located: DataFrame, bad_days: DataFrame | None = None, layer: str = "cumuarea", train: float = 0.7, seed: int = 42) -> SampleIndex:
    """Index, gate, group and split.

    The points are folded into a burn table once; the tile-day index, small beside the pixels,
    feeds every later step and is written to the shared folder too.
    """
    table = burn.burn_table(located, layer)
    fires = cut_lineage(tiles.tile_fires(table), "tile-fires")
    days = pairing.tile_days(fires)
    inputs = days if bad_days is None else pairing.pass_gate(days, bad_days)
    pairs = pairing.next_day_pairs(inputs, days)
    kept = pairing.keep_fires(fires, pairing.retained_fires(fires, pairs))
    members = cut_lineage(graph.super_fires(kept))
    points = located.select("id", "lat", "lon")
    stats = split.super_fire_stats(points, members)
    assigned = cut_lineage(
        split.split_fires(members, split.stratified_split(split.strata(split.size_and_place_bins(stats)), train, seed))
    )
    placed = kept.join(assigned.select("id", "split"), "id")
    return SampleIndex(placed, members, split_pairs(placed, bad_days), burn.masks_of(table))


def split_days(placed: DataFrame) -> DataFrame:
    """Tile-days with their split; the fires of a day share it."""
    return placed.groupBy(*TILE_DAY).agg(F.min("split").alias("split"))


def split_pairs(placed: DataFrame, bad_days: DataFrame | None = None) -> DataFrame:
    """Next-day samples whose input and target day belong to the same split.

    Two days of a tile may belong to fires of different splits; such a pair is no sample, since its labels
    would come from ground held out elsewhere.
    """
    days = split_days(placed)
    inputs = days if bad_days is None else pairing.pass_gate(days, bad_days)
    return pairing.next_day_pairs(inputs, days, within=("split",))


def next_day_labels(index: SampleIndex, classes: int = 2, history: bool = True) -> DataFrame:
    """Labelled pixels of every next-day sample."""
    fires = index.fires.drop("split")
    if classes == 2:
        return burn.new_growth(fires, index.masks, index.pairs, history).withColumn("label", F.lit(1))
    return burn.growth_labels(
        index.pairs, burn.current_mask(fires, index.masks, history), burn.day_mask(fires, index.masks), classes
    )


def sequence_samples(index: SampleIndex, n: int = 3, bad_days: DataFrame | None = None) -> DataFrame:
    """Sequence starts with split and positions; every input day must pass the gate, all days and the target share the split."""
    days = split_days(index.fires)
    inputs = days if bad_days is None else pairing.pass_gate(days, bad_days)
    return pairing.sequences(inputs, n, days, within=("split",)).withColumn("positions", pairing.positions(n))


def sequence_channels(sequences: DataFrame, channels: DataFrame, n: int = 3, keys: tuple[str, ...] = ("year", *TILE)) -> DataFrame:
    """Channel rows of every input step: ``(keys, start_dob, step, pixel, channels)``.

    ``channels`` are assembled once per tile-day and shared by the up to ``n`` sequences that use the day.
    """
    steps = pairing.sequence_steps(sequences.select(*keys, "start_dob"), n)
    return steps.join(channels, [*keys, "dob"])


def sequence_labels(index: SampleIndex, sequences: DataFrame, n: int = 3, classes: int = 2, history: bool = True) -> DataFrame:
    """Labels of sequences: growth from the last input day to the target day."""
    last = sequences.withColumn("dob", F.col("start_dob") + (n - 1))
    fires = index.fires.drop("split")
    if classes == 2:
        labels = burn.new_growth(fires, index.masks, last, history).withColumn("label", F.lit(1))
    else:
        labels = burn.growth_labels(
            last, burn.current_mask(fires, index.masks, history), burn.day_mask(fires, index.masks), classes
        )
    return labels.join(last.select(*TILE_DAY, "start_dob", "split"), list(TILE_DAY))


def summary(index: SampleIndex, labels: DataFrame) -> DataFrame:
    """Samples and labelled pixels per split."""
    pixels = labels.groupBy(*TILE_DAY).agg(F.count("*").alias("n"))
    return (
        index.pairs.join(pixels, list(TILE_DAY), "left")
        .groupBy("split")
        .agg(F.count("*").alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("new_pixels"))
    )
