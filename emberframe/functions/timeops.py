"""Calendar and time-zone functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dob_to_date(year: Column, dob: Column) -> Column:
    """Day-of-burn (day of year, 1 = 1 January) to a date."""
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (dob - 1).cast("int"))


def date_to_dob(date: Column) -> Column:
    return F.dayofyear(date)


def local_day_to_utc(date: Column, tz: Column) -> dict[str, Column]:
    """Month and UTC start/end/noon of a local calendar day.

    The end is 24 h after the start even when the clock changes; noon is localised on its own.
    ``convert_timezone`` works on zone-less timestamps, so the session zone plays no part.
    """
    midnight = date.cast("timestamp_ntz")
    to_utc = lambda ts: F.convert_timezone(tz, F.lit("UTC"), ts)
    start = to_utc(midnight)
    return {
        "month": F.month(date),
        "start_utc": start,
        "end_utc": start + F.expr("INTERVAL 24 HOURS"),
        "noon_utc": to_utc(midnight + F.expr("INTERVAL 12 HOURS")),
    }


def expected_date(noon: Column, start: Column, end: Column) -> Column:
    """Calendar day of a tile-day: the first known of noon, start and end."""
    return F.coalesce(noon, start, end).cast("date")


def fuel_vintage(year: Column) -> Column:
    return F.when(year > 2020, F.lit("2020")).otherwise(F.lit("2015"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
