"""Queries on satellite scenes and job status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.catalog import fixtures
from emberframe.catalog.points import located, points
from emberframe.catalog.registry import r, register
from emberframe.catalog.sql import R, query
from emberframe.functions import provenance as prov
from emberframe.functions import timeops, values
from emberframe.operators import satellite, tiles
from emberframe.operators.tiles import TILE
from emberframe.streaming import resume

SCL = 1  # the second band of the fixture plays the scene classification
TIERS_SQL = "CASE " + " ".join(f"WHEN cloud_needed <= {t} THEN {i}" for i, t in enumerate((40, 50, 60, 70, 80, 90, 100))) + " END"


def scenes(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "scene")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "scene_pixel")


def burn_days(spark: SparkSession, d: str) -> DataFrame:
    """Tile-days of the burn points, tiles numbered like the scenes."""
    number = F.pmod(F.col("tile_col") * 7 + F.col("tile_row"), F.lit(20)).alias("tile_no")
    return located(spark, d).select(number, timeops.dob_to_date(F.col("year"), F.col("dob")).alias("burn_date")).distinct()


DAYS_SQL = "SELECT DISTINCT cast((tile_col * 7 + tile_row) % 20 AS int) AS tile_no, cast(make_date(year, 1, 1) + (dob - 1) AS date) AS burn_date FROM tiled"
MOSAIC_SQL = """SELECT tile_no, acq_date, band, pixel,
      arg_min(value, rk) FILTER (WHERE value IS NOT NULL) AS value, min(cloud_cover) FILTER (WHERE value IS NOT NULL) AS cloud
    FROM scene_pixel JOIN (SELECT *, row_number() OVER (PARTITION BY tile_no, acq_date ORDER BY cloud_cover, scene_id) AS rk FROM scene) s
      USING (scene_id) GROUP BY ALL"""
ACCEPTED_SQL = f"""SELECT tile_no, acq_date, cloud_needed, {TIERS_SQL} AS tier FROM (
      SELECT tile_no, acq_date, max(cloud) AS cloud_needed FROM mosaic WHERE band <> 1
      GROUP BY ALL HAVING bool_and(value IS NOT NULL) AND bool_or(value <> 0)) q"""
CHOSEN_SQL = """SELECT tile_no, burn_date, acq_date, tier, lookback FROM (
      SELECT d.tile_no, d.burn_date, a.acq_date, a.tier, cast(d.burn_date - a.acq_date AS int) AS lookback,
             row_number() OVER (PARTITION BY d.tile_no, d.burn_date ORDER BY a.tier, d.burn_date - a.acq_date) AS rn
      FROM days d JOIN accepted a ON a.tile_no = d.tile_no AND a.acq_date BETWEEN d.burn_date - 29 AND d.burn_date) q WHERE rn = 1"""
CHAIN = dict(mosaic=MOSAIC_SQL, accepted=ACCEPTED_SQL, days=DAYS_SQL, chosen=CHOSEN_SQL)


def _date(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d') AS {name}"


def _dates_as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@register(
    "j7_scenes_in_lookback",
    query(
        f"""SELECT d.tile_no, {_date('burn_date')}, scene_id, cast(d.burn_date - s.acq_date AS int) AS lookback FROM days d JOIN scene s
            ON s.tile_no = d.tile_no AND s.acq_date BETWEEN d.burn_date - 29 AND d.burn_date AND s.cloud_cover <= 60""",
        "tiled", "scene", days=DAYS_SQL,
    ),
)
def j7(spark, d):
    out = satellite.scenes_in_lookback(burn_days(spark, d), scenes(spark, d), max_cloud=60.0)
    return _dates_as_text(out.select("tile_no", "burn_date", "scene_id", "lookback"), "burn_date")


@register(
    "j8_search_catalogue",
    query(
        f"""SELECT t.year, t.tile_col, t.tile_row, s.scene_id, {_date('acq_date')} FROM
            (SELECT year, tile_col, tile_row, min(lat) - 1e-1 AS y0, max(lat) + 1e-1 AS y1, min(lon) - 1e-1 AS x0, max(lon) + 1e-1 AS x1,
                    min(make_date(year, 1, 1) + (dob - 1)) - 29 AS d0, max(make_date(year, 1, 1) + (dob - 1)) + 2 AS d1
             FROM tiled GROUP BY year, tile_col, tile_row) t
            JOIN footprint s ON s.max_lon >= t.x0 AND s.min_lon <= t.x1 AND s.max_lat >= t.y0 AND s.min_lat <= t.y1
             AND s.acq_date BETWEEN t.d0 AND t.d1""",
        "tiled", "footprint",
    ),
)
def j8(spark, d):
    day = lambda c: timeops.dob_to_date(F.col("year"), F.col(c))
    boxes = tiles.extents(located(spark, d), ["year", *TILE]).withColumns(
        {"first_date": day("first_dob"), "last_date": day("last_dob")}
    )
    found = satellite.search_catalogue(boxes, fixtures.load(spark, d, "footprint"))
    return _dates_as_text(found.select("year", *TILE, "scene_id", "acq_date"), "acq_date")


@register(
    "a9_mosaic",
    query(
        f"""SELECT tile_no, {_date('acq_date')}, count(value) AS filled, cast(sum(value) AS bigint) AS total, {R('max(cloud)')} AS cloud,
                   cast(sum(value * (pixel + 1) * (band + 1)) AS bigint) AS checksum FROM mosaic GROUP BY tile_no, acq_date""",
        "scene", "scene_pixel", mosaic=MOSAIC_SQL,
    ),
)
def a9(spark, d):
    mosaic = satellite.daily_mosaic(scenes(spark, d), pixels(spark, d))
    out = mosaic.groupBy("tile_no", "acq_date").agg(
        F.count("value").alias("filled"), F.sum("value").alias("total"), F.max("cloud").alias("cloud"),
        F.sum(F.col("value") * (F.col("pixel") + 1) * (F.col("band") + 1)).alias("checksum"),
    )
    return _dates_as_text(out, "acq_date")


def _accepted(spark, d):
    mosaic = satellite.daily_mosaic(scenes(spark, d), pixels(spark, d))
    return mosaic, satellite.accepted_days(mosaic, scl_band=SCL)


@register("a10_accepted_days", query(f"SELECT tile_no, {_date('acq_date')}, tier, cloud_needed FROM accepted", "scene", "scene_pixel", mosaic=MOSAIC_SQL, accepted=ACCEPTED_SQL))
def a10(spark, d):
    return _dates_as_text(_accepted(spark, d)[1], "acq_date")


@register("w5_choose_day", query(f"SELECT tile_no, {_date('burn_date')}, {_date('acq_date')}, tier, lookback FROM chosen", "tiled", "scene", "scene_pixel", **CHAIN))
def w5(spark, d):
    chosen = satellite.choose_day(burn_days(spark, d), _accepted(spark, d)[1])
    return _dates_as_text(chosen, "burn_date", "acq_date")


@register(
    "chosen_mosaic",
    query(
        f"""SELECT tile_no, {_date('burn_date')}, count(value) AS filled, cast(sum(value * (pixel + 1) * (band + 1)) AS bigint) AS checksum
            FROM (SELECT c.tile_no, c.burn_date, band, pixel,
                         CASE WHEN cloud <= CASE WHEN tier = 0 THEN 40 ELSE 40 + 10 * tier END THEN value END AS value
                  FROM chosen c JOIN mosaic USING (tile_no, acq_date)) q GROUP BY tile_no, burn_date""",
        "tiled", "scene", "scene_pixel", **CHAIN,
    ),
)
def chosen_mosaic(spark, d):
    mosaic, accepted = _accepted(spark, d)
    out = satellite.chosen_mosaic(satellite.choose_day(burn_days(spark, d), accepted), mosaic)
    return _dates_as_text(
        out.groupBy("tile_no", "burn_date").agg(
            F.count("value").alias("filled"),
            F.sum(F.col("value") * (F.col("pixel") + 1) * (F.col("band") + 1)).alias("checksum"),
        ),
        "burn_date",
    )


@register(
    "satellite_channels",
    query(
        f"""SELECT tile_no, {_date('burn_date')}, count(*) AS pixels, cast(sum(b02 * (pixel + 1)) AS bigint) AS b02, count(scl) AS classified
            FROM (SELECT tile_no, burn_date, pixel, max(CASE WHEN band = 0 THEN value END) AS b02, max(CASE WHEN band = 1 THEN value END) AS scl
                  FROM (SELECT c.tile_no, c.burn_date, band, pixel,
                               CASE WHEN cloud <= CASE WHEN tier = 0 THEN 40 ELSE 40 + 10 * tier END THEN value END AS value
                        FROM chosen c JOIN mosaic USING (tile_no, acq_date)) q GROUP BY ALL) u GROUP BY tile_no, burn_date""",
        "tiled", "scene", "scene_pixel", **CHAIN,
    ),
)
def satellite_channels(spark, d):
    mosaic, accepted = _accepted(spark, d)
    chosen = satellite.chosen_mosaic(satellite.choose_day(burn_days(spark, d), accepted), mosaic)
    wide = satellite.band_columns(chosen, ("tile_no", "burn_date", "pixel"), {"s2_b02": 0, "s2_scl": SCL})
    return _dates_as_text(
        wide.groupBy("tile_no", "burn_date").agg(
            F.count("*").alias("pixels"), F.sum(F.col("s2_b02") * (F.col("pixel") + 1)).alias("b02"),
            F.count("s2_scl").alias("classified"),
        ),
        "burn_date",
    )


SHARES_SQL = """SELECT tile_no, acq_date, cloud AS cloud_cover_pct, round(n / total * 100, 2) AS pixels_pct FROM (
      SELECT tile_no, acq_date, cloud, count(*) AS n, sum(count(*)) OVER (PARTITION BY tile_no, acq_date) AS total
      FROM mosaic WHERE band = 0 GROUP BY tile_no, acq_date, cloud) q WHERE cloud IS NOT NULL"""


@register("a11_provenance", query(f"SELECT tile_no, {_date('acq_date')}, cloud_cover_pct, {R('pixels_pct', 2)} AS pixels_pct FROM shares", "scene", "scene_pixel", mosaic=MOSAIC_SQL, shares=SHARES_SQL))
def a11(spark, d):
    return _dates_as_text(satellite.provenance(_accepted(spark, d)[0]), "acq_date")


@register("c24_acquisition_stats_json", query(f"SELECT tile_no, {_date('acq_date')}, cloud_cover_pct, {R('pixels_pct', 2)} AS pixels_pct FROM shares", "scene", "scene_pixel", mosaic=MOSAIC_SQL, shares=SHARES_SQL))
def c24(spark, d):
    stats = satellite.provenance_list(satellite.provenance(_accepted(spark, d)[0]))
    text = stats.select("tile_no", prov.encode_stats(F.col("stats")).alias("text"))
    rows = text.select("tile_no", F.explode(prov.parse_stats(F.col("text"))).alias("s"))
    return rows.select("tile_no", F.col("s.acquisition_date").alias("acq_date"), "s.cloud_cover_pct", "s.pixels_pct")


@register(
    "c25_satellite_age",
    query(
        f"""SELECT d.tile_no, {_date('burn_date')}, coalesce(min(cast(d.burn_date - s.acq_date AS int)) FILTER (WHERE s.acq_date <= d.burn_date), 0) AS age
            FROM days d LEFT JOIN (SELECT DISTINCT tile_no, acq_date FROM scene) s
            ON s.tile_no = d.tile_no AND s.acq_date BETWEEN d.burn_date - 29 AND d.burn_date GROUP BY d.tile_no, d.burn_date""",
        "tiled", "scene", days=DAYS_SQL,
    ),
)
def c25(spark, d):
    entry = F.struct(F.lit(1.0).alias("pixels_pct"), "cloud_cover", F.col("acq_date").cast("string").alias("acquisition_date"))
    # A mosaic is made of the scenes of the 30 days up to its day, one acquisition per day and cloud cover.
    seen = scenes(spark, d).groupBy("tile_no", "acq_date").agg(F.min("cloud_cover").alias("cloud_cover"))
    reach = seen.withColumn("burn_date", F.explode(F.expr("sequence(acq_date, date_add(acq_date, 29))")))
    lists = reach.groupBy("tile_no", "burn_date").agg(F.collect_list(entry).alias("stats"))
    age = prov.sat_age_days(F.col("burn_date"), F.col("stats"))
    days = burn_days(spark, d).join(lists, ["tile_no", "burn_date"], "left")
    return _dates_as_text(days.select("tile_no", "burn_date", age.alias("age")), "burn_date")


@register(
    "c14_scale_satellite",
    query(f"SELECT scene_id, {R('sum(CASE WHEN band = 0 THEN value * 1e-4 END)')} AS reflectance, {R('sum(CASE WHEN band = 1 THEN value * 1e-1 END)', 4)} AS scl FROM scene_pixel GROUP BY scene_id", "scene_pixel"),
)
def c14(spark, d):
    v = F.col("value")
    band = lambda b, e: F.sum(F.when(F.col("band") == b, e))
    return pixels(spark, d).groupBy("scene_id").agg(
        r(band(0, values.scale_satellite(v, "b02"))).alias("reflectance"),
        r(band(1, values.scale_satellite(v, "SCL", scl_scale=0.1)), 4).alias("scl"),
    )


@register(
    "c16_nodata_mask",
    query("SELECT scene_id, count(CASE WHEN value <> 0 THEN value END) AS valid, cast(coalesce(sum(CASE WHEN value <> 0 THEN value END), 0) AS bigint) AS total FROM scene_pixel GROUP BY scene_id", "scene_pixel"),
)
def c16(spark, d):
    v = values.valid_or_null(F.col("value").cast("double"), 0.0)
    return pixels(spark, d).groupBy("scene_id").agg(F.count(v).alias("valid"), F.coalesce(F.sum(v), F.lit(0.0)).cast("bigint").alias("total"))


def _log(spark, d) -> DataFrame:
    return fixtures.load(spark, d, "status").withColumn("run", F.lit(1))


@register("j12_status_anti_join", query("SELECT fire_id FROM status WHERE status <> 'success'", "status"))
def j12(spark, d):
    log = _log(spark, d)
    return resume.pending_work(log.select("fire_id"), log)


@register(
    "s13_pending_work",
    query("SELECT fire_id FROM status JOIN scene ON scene_id = fire_id WHERE status <> 'success' AND cloud_cover > 50", "status", "scene"),
)
def s13(spark, d):
    log = _log(spark, d)
    work = log.select("fire_id")
    failed = scenes(spark, d).where("cloud_cover > 50").select(F.col("scene_id").alias("fire_id"))
    second = resume.outcome_rows(resume.pending_work(work, log), failed, run=2)
    return resume.pending_work(work, log.unionByName(second))
