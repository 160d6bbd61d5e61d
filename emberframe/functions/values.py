"""Masking, scaling, normalisation and label functions on pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberframe import constants as k

SATELLITE_SCALE = 1e-4


def binarise(v: Column) -> Column:
    return v > 0


def valid_or_null(v: Column, nodata: float | None = None) -> Column:
    """NaN and the nodata value become NULL, so that aggregates skip them."""
    bad = F.isnan(v)
    if nodata is not None:
        bad = bad | (v == F.lit(nodata))
    return F.when(~bad, v)


def finite_or_zero(v: Column) -> Column:
    infinite = F.abs(v) == F.lit(float("inf"))
    return F.when(v.isNull() | F.isnan(v) | infinite, F.lit(0.0)).otherwise(v)


def finite_or_null(v: Column) -> Column:
    return F.when(~(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))), v)


def cyclical(degrees: Column) -> tuple[Column, Column]:
    rad = F.radians(degrees)
    return F.sin(rad), F.cos(rad)


def scale_satellite(v: Column, band: str, scl_scale: float = SATELLITE_SCALE) -> Column:
    """Reflectance scaling; the scene classification uses its own factor (same by default)."""
    return v * F.lit(scl_scale if band.lower() in ("scl", "s2_scl") else SATELLITE_SCALE)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    """Normalise where statistics exist, otherwise pass the value through; NULL stays NULL."""
    return F.when(mean.isNull(), v).otherwise((v - mean) / std)


def zscore_or_zero(v: Column, mean: Column, std: Column) -> Column:
    return F.coalesce(zscore(v, mean, std), F.lit(0.0))


def fireday_channel(fireday: Column) -> Column:
    """First-burn day scaled by 100; 0 where the day is unknown or not positive."""
    return F.when(fireday > 0, fireday / F.lit(100.0)).otherwise(F.lit(0.0))


def growth_label(burned_now: Column, burned_next: Column, classes: int = 2) -> Column:
    """Two classes: new growth = 1.  Three classes: already burned = 1, new growth = 2."""
    growth = burned_next & ~burned_now
    if classes == 2:
        return F.when(growth, 1).otherwise(0)
    if classes == 3:
        return F.when(burned_now, 1).when(growth, 2).otherwise(0)
    raise ValueError("classes must be 2 or 3")


def feature_set(name: str, available: list[str] | tuple[str, ...] = k.CHANNELS) -> list[str]:
    """Channel names of a feature set; unknown sets or absent channels fail before any job runs."""
    if name not in k.FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}; known: {sorted(k.FEATURE_SETS)}")
    absent = [c for c in k.FEATURE_SETS[name] if c not in available]
    if absent:
        raise ValueError(f"channels {absent} of feature set {name!r} are not in the input")
    return list(k.FEATURE_SETS[name])


def narrow_types() -> dict[str, str]:
    """Storage types of exported samples (Spark has no unsigned or half types)."""
    return {"value": "float", "label": "smallint", "delta_t": "smallint", "position": "smallint"}
