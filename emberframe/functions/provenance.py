"""Acquisition provenance: JSON form and age of the imagery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATS_SCHEMA = "array<struct<pixels_pct:double,cloud_cover_pct:double,acquisition_date:string>>"


def encode_stats(stats: Column) -> Column:
    return F.to_json(stats)


def parse_stats(text: Column) -> Column:
    """Unparseable text gives NULL, which later counts as unknown age."""
    return F.from_json(text, STATS_SCHEMA)


def sat_age_days(expected: Column, stats: Column) -> Column:
    """Smallest non-negative gap in days between the burn day and an acquisition; 0 if unknown."""
    gaps = F.transform(stats, lambda s: F.datediff(expected, F.try_to_date(s["acquisition_date"])))
    return F.coalesce(F.array_min(F.filter(gaps, lambda g: g >= 0)), F.lit(0))
