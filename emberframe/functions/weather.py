"""Weather formulas and unit changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_speed_kmh(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v) * 3.6


def kmh(component: Column) -> Column:
    return component * 3.6


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def millimetres(metres: Column) -> Column:
    return metres * 1000.0


def relative_humidity(temp_c: Column, dew_c: Column) -> Column:
    return 100.0 * F.pow((112.0 - 0.1 * temp_c + dew_c) / (112.0 + 0.9 * temp_c), F.lit(8.0))
