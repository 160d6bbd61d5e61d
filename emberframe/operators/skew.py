"""Joins that stay even when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    many: DataFrame, one: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join a possibly skewed side to a side with one row per key.

    ``spread`` is any value that varies within a hot key; it decides the salt, so a recomputed
    task sends its rows to the same place.  The single rows are repeated once per salt, which the planner
    does not count, so they are never broadcast.
    """
    left = many.withColumn("_s", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_s"], how).drop("_s")
