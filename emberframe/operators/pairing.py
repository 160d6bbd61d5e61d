"""Sample indexing: which tile-days become samples, and with which fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.operators.tiles import TILE, TILE_DAY


def keep_fires(fires: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Fires of an active set (a split, the retained list)."""
    return fires.join(ids.select(key).distinct(), key, "left_semi")


def tile_days(fires: DataFrame) -> DataFrame:
    return fires.select(*TILE_DAY).distinct()


def complete_tile_days(cells: DataFrame, grid: int, keys: tuple[str, ...] = TILE_DAY) -> DataFrame:
    """Tile-days that have all their cells."""
    return cells.groupBy(*keys).agg(F.count("*").alias("cells")).where(F.col("cells") == grid * grid).select(*keys)


def pass_gate(days: DataFrame, bad_days: DataFrame, keys: tuple[str, ...] = TILE_DAY) -> DataFrame:
    """Tile-days without a bad pixel."""
    return days.join(bad_days.select(*keys).distinct(), list(keys), "left_anti")


def next_day_pairs(days: DataFrame, targets: DataFrame | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Tile-days with a following day in the same tile and year (never across 31 December).

    ``within`` names columns on which both days must agree: with ("split",) a day of one split never
    gets a target of another.
    """
    later = (days if targets is None else targets).select(
        "year", *TILE, *within, (F.col("dob") - 1).alias("dob"), F.col("dob").alias("next_dob")
    )
    return days.select(*TILE_DAY, *within).join(later, [*TILE_DAY, *within])


def sequences(
    input_days: DataFrame, n: int = 3, target_days: DataFrame | None = None, within: tuple[str, ...] = ()
) -> DataFrame:
    """Starts of ``n`` consecutive valid input days whose following day is a target.

    All steps and the target agree on the columns ``within``.

    Every day votes for the starts it can serve and a start with all votes stands: one shuffle,
    no self-join.  ``target_days`` may be wider than the inputs (targets are not quality-checked).
    """
    targets = input_days if target_days is None else target_days
    step = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    as_input = input_days.select(*TILE_DAY, *within).distinct().withColumn("step", step)
    as_target = targets.select(*TILE_DAY, *within).distinct().withColumn("step", F.lit(n))
    votes = as_input.unionByName(as_target).withColumn("start_dob", F.col("dob") - F.col("step"))
    return (
        votes.groupBy("year", *TILE, *within, "start_dob")
        .agg(F.count("*").alias("votes"))
        .where(F.col("votes") == n + 1)
        .select("year", *TILE, *within, "start_dob", (F.col("start_dob") + n).alias("target_dob"))
    )


def sequence_steps(starts: DataFrame, n: int = 3) -> DataFrame:
    """One row per input step of a sequence; ``dob`` is also the position of the step."""
    return starts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "dob", F.col("start_dob") + F.col("step")
    )


def positions(n: int = 3) -> Column:
    """Day-of-year positions of a sequence as SMALLINT."""
    return F.transform(
        F.sequence(F.col("start_dob"), F.col("start_dob") + (n - 1)), lambda p: p.cast("smallint")
    )


def retained_fires(fires: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids of fires used by any valid sample, as input or as target."""
    used = (
        pairs.select("year", *TILE, F.explode(F.array("dob", "next_dob")).alias("dob")).distinct()
    )
    return fires.join(used, list(TILE_DAY), "left_semi").select("id").distinct()


def primary_environment(environment: DataFrame, primary: DataFrame) -> DataFrame:
    """Environment rows of the primary fire only, so overlapping fires share one copy."""
    chosen = primary.select(*TILE_DAY, F.col("primary_fire").alias("id"), F.col("primary_fireday").alias("fireday"))
    return environment.join(chosen, [*TILE_DAY, "id", "fireday"], "left_semi")


def sample_counts(samples: DataFrame) -> DataFrame:
    """Samples and distinct fires per split."""
    return samples.groupBy("split").agg(F.count("*").alias("samples"), F.count_distinct("id").alias("fires"))
