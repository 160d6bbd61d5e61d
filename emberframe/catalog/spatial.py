"""Queries on polygons, irregular sites, warped rasters and statistics that grow by the day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.catalog import fixtures
from emberframe.catalog.pixels import raster
from emberframe.catalog.points import TD, located
from emberframe.catalog.registry import r, register, rounded
from emberframe.catalog.sql import R, SPAN, num, query
from emberframe.functions import timeops
from emberframe.functions.geo import lambert_parameters
from emberframe.operators import burn, nearest, pairing, regions, resample, states, strips, tiles
from emberframe.operators.tiles import PIXEL, TILE, TILE_DAY
from emberframe.session import scratch_path
from emberframe.sources import day_store

# ---- R7: cubic-spline warp of a raster in degrees onto the lattice ---------------------------------------------------

WARP_ORIGIN, WARP_STEP = (-124.55, 55.9), (0.03, 0.02)


def degree_cells(spark: SparkSession, d: str) -> DataFrame:
    """The 8x8 patches laid out as one raster in degrees; low values are missing."""
    return raster(spark, d).select(
        ((F.col("vec_id") % 20) * 8 + F.col("pixel_x")).alias("ix"), (F.floor(F.col("vec_id") / 20) * 8 + F.col("pixel_y")).alias("iy"),
        F.when(F.col("v") > -0.2, F.col("v")).alias("v"),
    )


_CONE = lambert_parameters()
_E = num(k.GRS80_E)
_PHI = f"pi() / 2 - 2 * atan(t * exp(-{_E} * atanh({_E} * sin(phi))))"
_UNPROJECTED = "SELECT *, pi() / 2 - 2 * atan(t) AS phi FROM cone"
for _ in range(5):
    _UNPROJECTED = f"SELECT * EXCLUDE (phi), {_PHI} AS phi FROM ({_UNPROJECTED}) u"
_BSPLINE = "CASE WHEN {a} < 1 THEN (4 - 6 * {a} * {a} + 3 * {a} * {a} * {a}) / 6 WHEN {a} < 2 THEN (2 - {a}) * (2 - {a}) * (2 - {a}) / 6 ELSE 0e0 END"
_NEAR = "(VALUES (-1), (0), (1), (2))"


@register(
    "r7_kernel_warp",
    query(
        f"""SELECT tile_col, tile_row, block_y, block_x, count(*) AS n, count(v) AS known, {R('avg(v)')} AS dem, {R('min(v)')} AS low, {R('max(v)')} AS high
            FROM (SELECT tile_col, tile_row, cast(floor(pixel_y / 16e0) AS int) AS block_y, cast(floor(pixel_x / 16e0) AS int) AS block_x, v FROM warped) q GROUP BY ALL""",
        "tiled", "raster",
        source="SELECT (vec_id % 20) * 8 + pixel_x AS ix, cast(floor(vec_id / 20e0) AS bigint) * 8 + pixel_y AS iy, v FROM raster WHERE v > -2e-1",
        cone=f"""SELECT tile_col, tile_row, pixel_y, pixel_x, degrees(atan2(x, y) / {num(_CONE['n'])}) + {num(k.ORIGIN_LON_DEG)} AS lon,
                   pow(sqrt(x * x + y * y) / {num(_CONE['scale'])}, {num(1 / _CONE['n'])}) AS t
            FROM (SELECT tile_col, tile_row, pixel_y, pixel_x, tile_col * {SPAN} + (pixel_x + 5e-1) * 9e1 - {num(k.FALSE_EASTING)} AS x,
                         {num(k.FALSE_NORTHING + _CONE['rho0'])} - ((tile_row + 1) * {SPAN} - (pixel_y + 5e-1) * 9e1) AS y
                  FROM (SELECT DISTINCT tile_col, tile_row FROM tiled) t, (SELECT range AS pixel_y FROM range(256)) a, (SELECT range AS pixel_x FROM range(256)) b) m""",
        aimed=f"SELECT *, (lon - {num(WARP_ORIGIN[0])}) / {num(WARP_STEP[0])} AS fx, (degrees(phi) - {num(WARP_ORIGIN[1])}) / {num(WARP_STEP[1])} AS fy FROM ({_UNPROJECTED}) p",
        warped=f"""SELECT tile_col, tile_row, pixel_y, pixel_x, CASE WHEN sum(w) > 1e-9 THEN sum(w * v) / sum(w) END AS v
            FROM (SELECT g.*, s.v, CASE WHEN s.v IS NULL THEN 0e0 ELSE ({_BSPLINE.format(a='abs(g.ix - g.fx)')}) * ({_BSPLINE.format(a='abs(g.iy - g.fy)')}) END AS w
                  FROM (SELECT aimed.*, cast(floor(fx) AS bigint) + i AS ix, cast(floor(fy) AS bigint) + j AS iy FROM aimed, {_NEAR} a(i), {_NEAR} b(j)) g
                  LEFT JOIN source s ON s.ix = g.ix AND s.iy = g.iy) x GROUP BY ALL""",
    ),
)
def r7_warp(spark, d):
    """Whole tiles of 256 x 256 cells of 90 m."""
    warped = resample.warp_geographic(located(spark, d).select(*TILE).distinct(), degree_cells(spark, d), WARP_ORIGIN, WARP_STEP)
    block = lambda c: F.floor(F.col(c) / 16).cast("int")
    return warped.groupBy(*TILE, block("pixel_y").alias("block_y"), block("pixel_x").alias("block_x")).agg(
        F.count("*").alias("n"), F.count("v").alias("known"), r(F.avg("v")).alias("dem"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high")
    )


# ---- J9, J8: polygons ------------------------------------------------------------------------------------------------

EDGES = """SELECT name, lon AS x1, lat AS y1, coalesce(lead(lon) OVER w, first(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first(lat) OVER w) AS y2
    FROM tz_polygon WINDOW w AS (PARTITION BY name, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@register(
    "j9_time_zone_polygons",
    query(
        """SELECT p.row_seq, coalesce(min(z.name), 'UTC') AS tz FROM burn_points p LEFT JOIN
             (SELECT row_seq, name FROM burn_points JOIN edges ON (y1 > lat) <> (y2 > lat) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon
              GROUP BY row_seq, name HAVING count(*) % 2 = 1) z USING (row_seq) GROUP BY p.row_seq""",
        "burn_points", "tz_polygon", edges=EDGES,
    ),
)
def j9_polygons(spark, d):
    index = regions.index_regions(fixtures.load(spark, d, "tz_polygon"), 0.25)
    found = regions.locate_in_regions(fixtures.load(spark, d, "burn_points"), index, 0.25, into="tz")
    return found.select("row_seq", F.coalesce("tz", F.lit("UTC")).alias("tz"))


@register(
    "j8_footprint_polygons",
    query(
        """SELECT year, tile_col, tile_row, scene_id, strftime(acq_date, '%Y-%m-%d') AS acq_date FROM
             (SELECT t.*, s.scene_id, s.acq_date, bool_or(greatest(ax, bx) >= x0 AND least(ax, bx) <= x1 AND greatest(ay, by_) >= y0 AND least(ay, by_) <= y1
                      AND least(s00, s01, s10, s11) <= 0 AND greatest(s00, s01, s10, s11) >= 0) AS crossed,
                     count(*) FILTER (WHERE (ay > y0) <> (by_ > y0) AND ax + (y0 - ay) * (bx - ax) / (by_ - ay) > x0) % 2 = 1 AS around
              FROM boxes t JOIN sides s ON s.acq_date BETWEEN t.d0 AND t.d1, LATERAL (SELECT
                     (bx - ax) * (y0 - ay) - (by_ - ay) * (x0 - ax) AS s00, (bx - ax) * (y1 - ay) - (by_ - ay) * (x0 - ax) AS s01,
                     (bx - ax) * (y0 - ay) - (by_ - ay) * (x1 - ax) AS s10, (bx - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax) AS s11) l
              GROUP BY ALL) q WHERE crossed OR around""",
        "tiled", "footprint_ring",
        boxes="""SELECT year, tile_col, tile_row, min(lat) - 1e-1 AS y0, max(lat) + 1e-1 AS y1, min(lon) - 1e-1 AS x0, max(lon) + 1e-1 AS x1,
                        min(make_date(year, 1, 1) + (dob - 1)) - 29 AS d0, max(make_date(year, 1, 1) + (dob - 1)) + 2 AS d1 FROM tiled GROUP BY year, tile_col, tile_row""",
        sides="""SELECT scene_id, acq_date, lon AS ax, lat AS ay, coalesce(lead(lon) OVER w, first(lon) OVER w) AS bx, coalesce(lead(lat) OVER w, first(lat) OVER w) AS by_
                 FROM footprint_ring WINDOW w AS (PARTITION BY scene_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    ),
)
def j8_polygons(spark, d):
    day = lambda c: timeops.dob_to_date(F.col("year"), F.col(c))
    boxes = tiles.extents(located(spark, d), ["year", *TILE]).withColumns({"first_date": day("first_dob"), "last_date": day("last_dob")})
    found = regions.search_footprints(boxes, fixtures.load(spark, d, "footprint_ring"))
    return found.select("year", *TILE, "scene_id", F.col("acq_date").cast("string").alias("acq_date"))


# ---- J3: nearest site anywhere ---------------------------------------------------------------------------------------


@register(
    "j3_nearest_station",
    query(
        f"""SELECT p.id, p.tile_col, p.tile_row, p.fireday, coalesce(s.station, -1) AS station, {R('coalesce(s.distance, -1)')} AS distance FROM firstrow p LEFT JOIN
             (SELECT id, year, tile_col, tile_row, fireday, arg_min(station, (d, station)) AS station, min(d) AS distance FROM
               (SELECT f.id, f.year, f.tile_col, f.tile_row, f.fireday, station, sqrt((f.lon - s.lon) * (f.lon - s.lon) + (f.lat - s.lat) * (f.lat - s.lat)) AS d
                FROM firstrow f JOIN station s ON f.lon BETWEEN (SELECT min(lon) FROM station) AND (SELECT max(lon) FROM station)
                 AND f.lat BETWEEN (SELECT min(lat) FROM station) AND (SELECT max(lat) FROM station)) q GROUP BY id, year, tile_col, tile_row, fireday) s
             USING (id, year, tile_col, tile_row, fireday)""",
        "firstrow", "station",
    ),
)
def j3_station(spark, d):
    first = tiles.first_rows(located(spark, d)).withColumn("key", F.monotonically_increasing_id())
    found = nearest.nearest_site(first, fixtures.load(spark, d, "station"), "key", "station")
    known = {"station": F.coalesce("station", F.lit(-1)), "distance": r(F.coalesce("distance", F.lit(-1.0)))}
    return found.withColumns(known).select("id", *TILE, "fireday", *known)


# ---- A6, S13: statistics that grow by the day ------------------------------------------------------------------------

_SIDE = f"ceil(ln(abs(m) / {num(states.LEAST)}) / {num(math.log(states.GROWTH))})"
_MIDDLE = f"{num(states.LEAST)} * pow({num(states.GROWTH)}, {_SIDE}) * {num(2 / (1 + states.GROWTH))}"


@register(
    "a6_merged_states",
    query(
        f"""SELECT feature, {R('avg(v)')} AS mean, {R('stddev_pop(v) + 1e-8')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max, count(*) AS count,
                   {R(f"any_value(CASE WHEN abs(m) <= {num(states.LEAST)} THEN 0e0 WHEN m > 0 THEN {_MIDDLE} ELSE -{_MIDDLE} END)")} AS median
            FROM (SELECT *, max(CASE WHEN rn = floor((n - 1) / 2e0) THEN v END) OVER (PARTITION BY feature) AS m
                  FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY feature) AS n FROM long) a) b GROUP BY feature""",
        "raster", long="SELECT 'tmax' AS feature, v FROM raster UNION ALL SELECT 'rh', v * v FROM raster",
    ),
)
def a6_merged(spark, d):
    """Days come in two runs; the second one breaks off before its record and is repeated."""
    pixels = raster(spark, d).select((F.col("vec_id") % 10).alias("day"), F.col("v").alias("tmax"), (F.col("v") * F.col("v")).alias("rh"))
    days = pixels.select("day").distinct()
    path = scratch_path(spark, "states")

    def run(wanted: DataFrame, broken: bool = False) -> None:
        todo = day_store.pending_days(wanted, path)
        rows = states.day_states(pixels.join(todo, "day", "left_semi"), ["tmax", "rh"])
        day_store.write_days(rows, path)
        if not broken:
            day_store.commit_days(todo, path)

    run(days.where("day < 6"))
    run(days, broken=True)
    run(days)
    merged = states.summary(states.merge_states(day_store.read_days(spark, path), "feature"))
    return rounded(merged, "mean", "std", "min", "max", "median")


# ---- samples of 256 x 256 pixels of 90 m, as strips ------------------------------------------------------------------

_CELL = "pixel_y * 256 + pixel_x + 1"


@register(
    "e2_strip_samples",
    query(
        f"""SELECT {TD}, 65536 AS cells, coalesce(burned, 0) AS burned, coalesce(fireday, 0) AS fireday, coalesce(reached, 0) AS reached,
                   coalesce(around, 0) AS around, coalesce(n_grown, 0) AS grown, coalesce(label, 0) AS label
            FROM (SELECT {TD} FROM pairs) p LEFT JOIN old USING ({TD}) LEFT JOIN front USING ({TD}) LEFT JOIN fresh USING ({TD})""",
        "grown", "cur", "pairs",
        base=f"SELECT c.* FROM cur c JOIN pairs USING ({TD})",
        near=f"""SELECT {TD}, y, x, count(*) AS n FROM
            (SELECT {TD}, pixel_y + dy AS y, pixel_x + dx AS x FROM base, (SELECT unnest(range(-1, 2)) AS dy) a, (SELECT unnest(range(-1, 2)) AS dx) b) m
            WHERE y BETWEEN 0 AND 255 AND x BETWEEN 0 AND 255 GROUP BY ALL""",
        front=f"SELECT {TD}, count(*) AS reached, cast(sum(n * (y * 256 + x + 1)) AS bigint) AS around FROM near GROUP BY {TD}",
        old=f"SELECT {TD}, count(*) AS burned, cast(sum(first_fireday * ({_CELL})) AS bigint) AS fireday FROM base GROUP BY {TD}",
        fresh=f"SELECT {TD}, count(*) AS n_grown, cast(sum({_CELL}) AS bigint) AS label FROM grown GROUP BY {TD}",
    ),
)
def e2_strip_samples(spark, d):
    """Input and label arrays of every next-day pair at full size: first burn day, burned cells around each cell, new growth."""
    cells = burn.pair_cells(burn.fire_lists(tiles.locate(fixtures.load(spark, d, "burn_points", spread=False))))
    keys = (*TILE_DAY, "day_block")
    # A word per cell: new growth, burned so far, first burn day in 16 bits.
    day = F.col("first_fireday").cast("smallint").cast("bigint").bitwiseAND(F.lit((1 << 16) - 1)) * 4 + 2
    channels = {
        "first_fireday": lambda w: F.shiftright(F.shiftleft(w, 46), 48).cast("smallint"),
        "burned": lambda w: F.getbit(w, F.lit(1)), "label": lambda w: F.getbit(w, F.lit(0)),
    }
    rows = strips.gather(cells, F.coalesce(day, F.col("grown").cast("bigint")), channels, keys)
    rows = strips.window(rows, "burned", "around", lambda a, b: a + b, 0, keys=keys)
    packed = strips.pack(rows, ["first_fireday", "burned", "around", "label"], keys)
    # Read back cell by cell.
    names = {"first_fireday": "fireday", "around": "around", "label": "label"}
    cells = packed.select(*keys, "burned", *names, F.size("label").alias("cells"), F.explode(F.sequence(F.lit(0), F.lit(k.GRID_SIZE**2 - 1))).alias("i"))
    value = lambda c: F.get(c, F.col("i")).cast("bigint")
    return cells.groupBy(*keys, "cells").agg(
        *[F.sum(value(c) * (F.col("i") + 1)).alias(new) for c, new in names.items()],
        *[F.count_if(value(c) != 0).alias(new) for c, new in (("burned", "burned"), ("around", "reached"), ("label", "grown"))],
    ).drop("day_block")
