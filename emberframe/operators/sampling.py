"""Limits and samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.functions.probability import order_hash
from emberframe.operators.ranking import take_by_hash


def first_k(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows by name: a top-k, each task keeps at most ``k`` rows."""
    return df.orderBy(*order).limit(k)


def of_class(pixels: DataFrame, positive: bool, label: str = "label") -> DataFrame:
    return pixels.where(F.col(label) == (1 if positive else 0))


def balanced_sample(
    pixels: DataFrame, keys: list[str], max_positive: int, negative_ratio: float = 1.0,
    seed: int = 42, label: str = "label",
) -> DataFrame:
    """Class quotas without replacement in keyed hash order.

    Fails when a class is empty: the check is an expression on the class counts, raised by the job.
    """
    quota = F.when(F.col(label) == 1, F.lit(max_positive)).otherwise(
        F.lit(int(math.ceil(max_positive * negative_ratio)))
    )
    classes = pixels.agg(F.count_distinct(F.when(F.col(label).isin(0, 1), F.col(label))).alias("n")).scalar()
    picked = take_by_hash(pixels, [label], order_hash(seed, *[F.col(c) for c in keys]), keys, quota)
    both = F.when(classes == 2, F.lit(True)).otherwise(F.raise_error(F.lit("sampling needs both classes")).cast("boolean"))
    return picked.where(both)


def interesting(masks: DataFrame, keys: tuple[str, ...], min_pixels: int = 30, classes: int = 2, label: str = "label") -> DataFrame:
    """Samples with enough pixels of the target class (three classes: of both fire classes)."""
    counts = masks.groupBy(*keys).agg(
        F.count_if(F.col(label) == 1).alias("class_1"), F.count_if(F.col(label) == 2).alias("class_2")
    )
    enough = F.col("class_1") >= min_pixels
    return counts.where(enough & (F.col("class_2") >= min_pixels) if classes == 3 else enough)


def best_samples(scored: DataFrame, score: str, ties: list[str], cap: int = 300) -> DataFrame:
    """Top scored samples (a report, so capped)."""
    return scored.orderBy(F.col(score).desc(), *ties).limit(cap)
