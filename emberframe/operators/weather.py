"""Hourly weather: de-duplication, 24-hour features and nearest-cell sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.functions import geo
from emberframe.functions import weather as wx

CELL = ("latitude", "longitude")
HOURS = 24


def deduplicate_hours(hourly: DataFrame, source: str = "source") -> DataFrame:
    """Keep, per hour, the source with the most known temperatures (later source on ties).

    The choice is made per hour from counts over all cells; it is joined back as one row per hour.
    """
    quality = hourly.groupBy("valid_time", source).agg(F.count("t2m").alias("known"))
    best = quality.groupBy("valid_time").agg(F.max(F.struct("known", source)).alias("best"))
    chosen = best.select("valid_time", F.col(f"best.{source}").alias(source))
    # One row per hour of the archive (8 784 a year), so broadcasting it is bounded by the calendar.
    return hourly.join(F.broadcast(chosen), ["valid_time", source])


def deaccumulate(hourly: DataFrame) -> DataFrame:
    """Hourly precipitation from a running total that restarts every day."""
    spec = Window.partitionBy(*CELL).orderBy("valid_time")
    step = F.col("tp") - F.lag("tp").over(spec)
    restart = (F.hour("valid_time") == 1) | F.coalesce(step < -1e-7, F.lit(False))
    return hourly.withColumn("tp_hourly", F.when(restart, F.col("tp")).otherwise(step))


def rolling_day(hourly: DataFrame, rows: int = HOURS) -> DataFrame:
    """Maximum temperature and precipitation sum over the last 24 rows of a cell.

    Windows count rows, not hours, and stay NULL until every row is known.  After
    de-duplication a cell has one row per hour, so a window partition is bounded by the calendar.
    """
    spec = Window.partitionBy(*CELL).orderBy("valid_time").rowsBetween(-(rows - 1), 0)
    full = lambda c, agg: F.when(F.count(c).over(spec) == rows, agg(c).over(spec))
    return hourly.withColumns({"t2m_24h_max": full("t2m", F.max), "tp_24h_sum": full("tp_hourly", F.sum)})


def hourly_features(hourly: DataFrame) -> DataFrame:
    return rolling_day(deaccumulate(hourly))


def needed_months(noons: DataFrame, noon: str = "noon_utc") -> DataFrame:
    """Months to read: that of each day, and the neighbour when a day touches the month's edge."""
    day = F.col(noon).cast("date")
    month = F.trunc(day, "month")
    wanted = F.array_compact(
        F.array(
            month,
            F.when(F.dayofmonth(day) == 1, F.add_months(month, -1)),
            F.when(day == F.last_day(day), F.add_months(month, 1)),
        )
    )
    months = noons.where(F.col(noon).isNotNull()).select(F.explode(wanted).alias("m")).distinct()
    return months.select(F.year("m").alias("year"), F.month("m").alias("month"))


def crop(df: DataFrame, box: dict[str, float], buffer: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows inside a box widened by a buffer; literals, so the predicate reaches the scan."""
    return df.where(
        F.col(lat).between(box["min_lat"] - buffer, box["max_lat"] + buffer)
        & F.col(lon).between(box["min_lon"] - buffer, box["max_lon"] + buffer)
    )


def with_times(days: DataFrame) -> DataFrame:
    """Tile-days whose timestamps are known."""
    return days.where(F.col("noon_utc").isNotNull())


def grid_extent(hourly: DataFrame) -> DataFrame:
    """Edges of the cell grid, one row."""
    return hourly.agg(
        F.min("latitude").alias("lat_lo"), F.max("latitude").alias("lat_hi"),
        F.min("longitude").alias("lon_lo"), F.max("longitude").alias("lon_hi"),
    )


def _snap(df: DataFrame, lat: str, lon: str, step: float) -> DataFrame:
    return df.withColumns(
        {
            "_cy": geo.snap_index(F.col(lat), 0.0, step),
            "_cx": geo.snap_index(F.col(lon), 0.0, step),
        }
    )


def sample_weather(points: DataFrame, features: DataFrame, when: str, values: list[str], step: float = 0.1) -> DataFrame:
    """Values of the nearest grid cell at the nearest hour; NULL outside the grid.

    The grid is regular in space and time, so "nearest" is a rounded key and the lookup an equi-join.
    """
    edge = grid_extent(features).select(F.struct("lat_lo", "lat_hi", "lon_lo", "lon_hi").alias("e")).scalar()
    inside = F.col("lat").between(F.col("_e.lat_lo"), F.col("_e.lat_hi")) & F.col("lon").between(
        F.col("_e.lon_lo"), F.col("_e.lon_hi")
    )
    hour = F.date_trunc("hour", F.col(when) + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")
    left = _snap(points.withColumn("_e", edge), "lat", "lon", step).withColumn("_h", F.when(inside, hour))
    right = _snap(features, *CELL, step).select(
        "_cy", "_cx", F.col("valid_time").cast("timestamp_ntz").alias("_h"), *values
    )
    return left.join(right, ["_cy", "_cx", "_h"], "left").drop("_cy", "_cx", "_h", "_e")


def daily_weather(points: DataFrame, features: DataFrame, step: float = 0.1) -> DataFrame:
    """The six weather channels: noon + 1 h for wind, humidity and precipitation, day end for heat."""
    at_noon = points.withColumn("_t", F.col("noon_utc") + F.expr("INTERVAL 1 HOUR"))
    noon = sample_weather(at_noon, features, "_t", ["t2m", "d2m", "u10", "v10", "tp_24h_sum"], step)
    both = sample_weather(noon.drop("_t"), features, "end_utc", ["t2m_24h_max"], step)
    t, d = wx.celsius(F.col("t2m")), wx.celsius(F.col("d2m"))
    return both.withColumns(
        {
            "tmax": wx.celsius(F.col("t2m_24h_max")),
            "rh": wx.relative_humidity(t, d),
            "ws": wx.wind_speed_kmh(F.col("u10"), F.col("v10")),
            "prec": wx.millimetres(F.col("tp_24h_sum")),
            "u10": wx.kmh(F.col("u10")),
            "v10": wx.kmh(F.col("v10")),
        }
    ).drop("t2m", "d2m", "tp_24h_sum", "t2m_24h_max")
