"""Queries on weather, vegetation and static rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.catalog import fixtures
from emberframe.catalog.points import located, metadata, points
from emberframe.catalog.registry import r, register, rounded
from emberframe.catalog.sql import R, query
from emberframe.functions import timeops
from emberframe.functions import weather as wx
from emberframe.operators import surface, weather
from emberframe.operators.tiles import PIXEL
from emberframe.session import scratch_path
from emberframe.sources import tables

HOUR_SQL = "strftime(valid_time, '%Y-%m-%d %H') AS hour"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "weather_hourly")


def _stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.date_format("valid_time", "yyyy-MM-dd HH")).drop("valid_time")


@register(
    "c9_wind_speed",
    query(f"SELECT {HOUR_SQL}, latitude, longitude, {R('sqrt(u10 * u10 + v10 * v10) * 36e-1')} AS ws, {R('u10 * 36e-1')} AS u_kmh, {R('v10 * 36e-1')} AS v_kmh FROM weather_hourly", "weather_hourly"),
)
def c9(spark, d):
    u, v = F.col("u10"), F.col("v10")
    return _stamp(hourly(spark, d)).select(
        "hour", "latitude", "longitude", r(wx.wind_speed_kmh(u, v)).alias("ws"), r(wx.kmh(u)).alias("u_kmh"), r(wx.kmh(v)).alias("v_kmh")
    )


@register(
    "c10_relative_humidity",
    query(f"SELECT {HOUR_SQL}, latitude, longitude, {R('100 * pow((112 - 1e-1 * t + w) / (112 + 9e-1 * t), 8)')} AS rh FROM (SELECT *, t2m - 27315e-2 AS t, d2m - 27315e-2 AS w FROM weather_hourly) q", "weather_hourly"),
)
def c10(spark, d):
    rh = wx.relative_humidity(wx.celsius(F.col("t2m")), wx.celsius(F.col("d2m")))
    return _stamp(hourly(spark, d)).select("hour", "latitude", "longitude", r(rh).alias("rh"))


@register(
    "c11_units",
    query(f"SELECT {HOUR_SQL}, latitude, longitude, {R('t2m - 27315e-2')} AS celsius, {R('tp * 1e3')} AS mm FROM weather_hourly", "weather_hourly"),
)
def c11(spark, d):
    return _stamp(hourly(spark, d)).select(
        "hour", "latitude", "longitude", r(wx.celsius(F.col("t2m"))).alias("celsius"), r(wx.millimetres(F.col("tp"))).alias("mm")
    )


# Burn days moved to January 2024, where the hourly weather is.
NOON_SQL = "cast(make_date(2024, 1, 1) + (dob - 150) AS timestamp) + INTERVAL 18 HOUR"


def _in_january(df: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("dob") - 150).cast("timestamp_ntz")
    return df.withColumns(
        {"noon_utc": day + F.expr("INTERVAL 18 HOURS"), "end_utc": day + F.expr("INTERVAL 30 HOURS")}
    )


@register(
    "s11_scan_weather",
    query("SELECT cast(year(valid_time) AS int) AS year, cast(month(valid_time) AS int) AS month, latitude, longitude, count(*) AS n FROM weather_hourly GROUP BY ALL", "weather_hourly"),
)
def s11(spark, d):
    path = scratch_path(spark, "weather")
    tables.write_weather(hourly(spark, d), path)
    months = weather.needed_months(_in_january(points(spark, d)).select("noon_utc"))
    rows = tables.scan_weather(spark, path, months)
    return rows.groupBy("year", "month", "latitude", "longitude").agg(F.count("*").alias("n"))


@register(
    "w7_needed_months",
    query(
        """SELECT DISTINCT cast(year(m) AS int) AS year, cast(month(m) AS int) AS month FROM (
             SELECT date_trunc('month', noon_utc) AS m FROM meta
             UNION SELECT date_trunc('month', noon_utc) - INTERVAL 1 MONTH FROM meta WHERE day(noon_utc) = 1
             UNION SELECT date_trunc('month', noon_utc) + INTERVAL 1 MONTH FROM meta WHERE cast(noon_utc AS date) = last_day(noon_utc)) q""",
        "meta",
    ),
)
def w7(spark, d):
    return weather.needed_months(metadata(spark, d))


@register(
    "f6_crop_with_buffer",
    query("SELECT row_seq, lon, lat FROM burn_points WHERE lat BETWEEN 564e-1 - 1e-1 AND 569e-1 + 1e-1 AND lon BETWEEN -1231e-1 - 1e-1 AND -1222e-1 + 1e-1", "burn_points"),
)
def f6(spark, d):
    box = {"min_lat": 56.4, "max_lat": 56.9, "min_lon": -123.1, "max_lon": -122.2}
    return weather.crop(points(spark, d), box, 0.1, "lat", "lon").select("row_seq", "lon", "lat")


@register(
    "f8_known_timestamps",
    query("SELECT id, tile_col, tile_row, fireday FROM meta WHERE tz <> 'UTC' AND dob < 180", "meta"),
)
def f8(spark, d):
    known = (F.col("tz") != "UTC") & (F.col("dob") < 180)
    days = metadata(spark, d).withColumn("noon_utc", F.when(known, F.col("noon_utc")))
    return weather.with_times(days).select("id", "tile_col", "tile_row", "fireday")


HOURLY_SQL = """SELECT *, CASE WHEN hour(valid_time) = 1 OR coalesce(step < -1e-7, false) THEN tp ELSE step END AS tp_hourly
    FROM (SELECT *, tp - lag(tp) OVER (PARTITION BY latitude, longitude ORDER BY valid_time) AS step FROM weather_hourly) q"""
ROLLING_SQL = """SELECT *, CASE WHEN count(t2m) OVER w = 24 THEN max(t2m) OVER w END AS t2m_24h_max,
    CASE WHEN count(tp_hourly) OVER w = 24 THEN sum(tp_hourly) OVER w END AS tp_24h_sum FROM hourly
    WINDOW w AS (PARTITION BY latitude, longitude ORDER BY valid_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


@register(
    "w1_rolling_day",
    query(f"SELECT {HOUR_SQL}, latitude, longitude, {R('t2m_24h_max')} AS t2m_24h_max, {R('tp_24h_sum', 8)} AS tp_24h_sum FROM rolling", "weather_hourly", hourly=HOURLY_SQL, rolling=ROLLING_SQL),
)
def w1(spark, d):
    out = _stamp(weather.hourly_features(hourly(spark, d)))
    return out.select("hour", "latitude", "longitude", r("t2m_24h_max").alias("t2m_24h_max"), r("tp_24h_sum", 8).alias("tp_24h_sum"))


@register("w2_deaccumulate", query(f"SELECT {HOUR_SQL}, latitude, longitude, {R('tp_hourly', 8)} AS tp_hourly FROM hourly", "weather_hourly", hourly=HOURLY_SQL))
def w2(spark, d):
    return rounded(_stamp(weather.deaccumulate(hourly(spark, d))).select("hour", "latitude", "longitude", "tp_hourly"), "tp_hourly", digits=8)


@register(
    "w3_deduplicate_hours",
    query(
        f"""SELECT {HOUR_SQL}, source, latitude, longitude, {R('t2m')} AS t2m FROM weather_sources JOIN
            (SELECT valid_time, source, row_number() OVER (PARTITION BY valid_time ORDER BY count(t2m) DESC, source DESC) AS rn
             FROM weather_sources GROUP BY valid_time, source) q USING (valid_time, source) WHERE rn = 1""",
        "weather_sources",
    ),
)
def w3(spark, d):
    kept = weather.deduplicate_hours(fixtures.load(spark, d, "weather_sources"))
    return rounded(_stamp(kept).select("hour", "source", "latitude", "longitude", "t2m"), "t2m")


@register(
    "j3_nearest_weather",
    query(
        f"""SELECT p.row_seq, {R('e.t2m_24h_max - 27315e-2')} AS tmax, {R('sqrt(n.u10 * n.u10 + n.v10 * n.v10) * 36e-1')} AS ws,
                   {R('n.tp_24h_sum * 1e3')} AS prec, {R('n.u10 * 36e-1')} AS u10,
                   {R('100 * pow((112 - 1e-1 * (n.t2m - 27315e-2) + (n.d2m - 27315e-2)) / (112 + 9e-1 * (n.t2m - 27315e-2)), 8)')} AS rh
            FROM (SELECT *, floor(lat / 1e-1 + 5e-1) AS cy, floor(lon / 1e-1 + 5e-1) AS cx, {NOON_SQL} AS noon, lat BETWEEN (SELECT min(latitude) FROM rolling) AND (SELECT max(latitude) FROM rolling)
                    AND lon BETWEEN (SELECT min(longitude) FROM rolling) AND (SELECT max(longitude) FROM rolling) AS inside FROM burn_points) p
            LEFT JOIN cells n ON p.inside AND n.cy = p.cy AND n.cx = p.cx AND n.valid_time = p.noon + INTERVAL 1 HOUR
            LEFT JOIN cells e ON p.inside AND e.cy = p.cy AND e.cx = p.cx AND e.valid_time = p.noon + INTERVAL 12 HOUR""",
        "burn_points", "weather_hourly", hourly=HOURLY_SQL, rolling=ROLLING_SQL,
        cells="SELECT *, floor(latitude / 1e-1 + 5e-1) AS cy, floor(longitude / 1e-1 + 5e-1) AS cx FROM rolling",
    ),
)
def j3(spark, d):
    features = weather.hourly_features(hourly(spark, d))
    pts = _in_january(points(spark, d).select("row_seq", "lon", "lat", "dob"))
    out = weather.daily_weather(pts, features)
    return rounded(out.select("row_seq", "tmax", "ws", "prec", "u10", "rh"), "tmax", "ws", "prec", "u10", "rh")


def mosaic_cells(spark: SparkSession, d: str) -> DataFrame:
    """The 8x8 patches laid out as one raster of 2 km cells over the burned region."""
    return fixtures.load(spark, d, "raster").select(
        (4.3e6 + ((F.col("vec_id") % 20) * 8 + F.col("pixel_x")) * 2e3).alias("x"),
        (2.5e6 + (F.floor(F.col("vec_id") / 20) * 8 + F.col("pixel_y")) * 2e3).alias("y"), "v",
    )


MOSAIC_SQL = """SELECT (vec_id % 20) * 8 + pixel_x AS ix, cast(floor(vec_id / 20e0) AS bigint) * 8 + pixel_y AS iy, v FROM raster"""


@register(
    "j4_nearest_static",
    query(
        f"""SELECT row_seq, {R('v')} AS v FROM (
              SELECT row_seq, least(greatest(cast(floor((easting - 43e5) / 2e3 + 5e-1) AS bigint), 0), (SELECT max(ix) FROM mosaic)) AS ix,
                     least(greatest(cast(floor((northing - 25e5) / 2e3 + 5e-1) AS bigint), 0), (SELECT max(iy) FROM mosaic)) AS iy FROM proj) p
            LEFT JOIN mosaic USING (ix, iy)""",
        "proj", "raster", mosaic=MOSAIC_SQL,
    ),
)
def j4(spark, d):
    pts = located(spark, d).select("row_seq", "easting", "northing")
    out = surface.nearest_static(pts, mosaic_cells(spark, d), (4.3e6, 2.5e6), 2e3, "v")
    return out.select("row_seq", r("v").alias("v"))


@register(
    "j10_statics_on_days",
    query(
        f"""SELECT a.vec_id, count(s.v) AS matched, {R('sum(a.v * s.v)')} AS dot FROM raster a LEFT JOIN
            (SELECT label, pixel_y, pixel_x, arg_min(v, vec_id) AS v FROM raster WHERE label < 8 GROUP BY ALL) s
            USING (label, pixel_y, pixel_x) GROUP BY a.vec_id""",
        "raster",
    ),
)
def j10(spark, d):
    pixels = fixtures.load(spark, d, "raster")
    statics = pixels.where("label < 8").groupBy("label", *PIXEL).agg(F.min_by("v", "vec_id").alias("dem"))
    joined = surface.with_statics(pixels, statics, ("label", *PIXEL))
    return joined.groupBy("vec_id").agg(F.count("dem").alias("matched"), r(F.sum(F.col("v") * F.col("dem"))).alias("dot"))


def layer_cells(spark: SparkSession, d: str) -> DataFrame:
    """Raster patches as named static layers: seven consecutive patches make one tile."""
    names = F.array(*[F.lit(n) for n in k.STATIC_FEATURES])
    return fixtures.load(spark, d, "raster").select(
        F.element_at(names, (F.col("vec_id") % 7 + 1).cast("int")).alias("layer"),
        F.floor(F.col("vec_id") / 7).alias("tile"), *PIXEL, F.col("v").alias("value"),
    )


@register(
    "s12_scan_static_layers",
    query(
        f"""SELECT cast(floor(vec_id / 7e0) AS bigint) AS tile, pixel_y, pixel_x, {R('max(CASE WHEN vec_id % 7 = 0 THEN v END)')} AS dem,
                   {R('max(CASE WHEN vec_id % 7 = 1 THEN v END)')} AS slope, {R('max(CASE WHEN vec_id % 7 = 2 THEN v END)')} AS aspect
            FROM raster WHERE vec_id % 7 < 3 GROUP BY ALL""",
        "raster",
    ),
)
def s12(spark, d):
    path = scratch_path(spark, "layers")
    tables.write_layers(layer_cells(spark, d), path)
    wanted = ("dem", "slope", "aspect")
    wide = surface.pivot_layers(tables.scan_layers(spark, path, list(wanted)), ["tile", *PIXEL], wanted)
    return rounded(wide, *wanted)


def composites(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "veg_composite")


ASOF_SQL = """SELECT b.id, b.dob, CASE WHEN max(v.time_start) >= b.first_date - 5 THEN max(v.time_start) END AS time_start
    FROM (SELECT id, dob - 149 AS dob, make_date(2024, 1, 1) + (dob - 150) AS burn_date,
                 min(make_date(2024, 1, 1) + (dob - 150)) OVER (PARTITION BY id) AS first_date
          FROM (SELECT DISTINCT id, dob FROM burn_points) q) b
    LEFT JOIN (SELECT DISTINCT time_start FROM veg_composite) v ON v.time_start + 4 <= b.burn_date
    GROUP BY b.id, b.dob, b.first_date"""


def _burn_days(spark, d) -> DataFrame:
    """Fire days moved to 2024, where the composites are."""
    days = points(spark, d).select("id", F.lit(2024).alias("year"), (F.col("dob") - 149).alias("dob")).distinct()
    return days.withColumn("burn_date", timeops.dob_to_date(F.col("year"), F.col("dob")))


@register("j6_asof_composite", query("SELECT id, dob, strftime(time_start, '%Y-%m-%d') AS time_start FROM picked", "burn_points", "veg_composite", picked=ASOF_SQL))
def j6(spark, d):
    out = surface.asof_composite(_burn_days(spark, d), composites(spark, d), lag_days=4, lookback_days=6)
    return out.select("id", "dob", F.col("time_start").cast("string").alias("time_start"))


@register(
    "j5_nearest_vegetation",
    query(
        f"""SELECT p.row_seq, {R('v.ndvi')} AS ndvi, {R('v.evi')} AS evi FROM
              (SELECT row_seq, id, dob - 149 AS dob, least(cast(floor(lon + 124e0) AS int), 3) AS cx, least(cast(floor(58e0 - lat) AS int), 1) AS cy FROM burn_points) p
              JOIN picked a USING (id, dob)
              LEFT JOIN veg_composite v ON v.time_start = a.time_start AND v.cell = p.cy * 4 + p.cx""",
        "burn_points", "veg_composite", picked=ASOF_SQL,
    ),
)
def j5(spark, d):
    chosen = surface.asof_composite(_burn_days(spark, d), composites(spark, d), lag_days=4, lookback_days=6)
    pts = points(spark, d).select("row_seq", "id", (F.col("dob") - 149).alias("dob"), "lon", "lat")
    dated = pts.join(chosen.select("id", "dob", "time_start"), ["id", "dob"])
    out = surface.nearest_vegetation(dated, composites(spark, d), ["ndvi", "evi"], lon0=-124.0, lat0=58.0, per_degree=1.0)
    return rounded(out.select("row_seq", "ndvi", "evi"), "ndvi", "evi")
