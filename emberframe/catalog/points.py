"""Queries on burn points, tile-days, masks, super-fires and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.catalog import fixtures
from emberframe.catalog.registry import r, register, rounded
from emberframe.catalog.sql import R, query, tiling
from emberframe.functions import geo, timeops, values
from emberframe.operators import burn, graph, pairing, sampling, split, tiles
from emberframe.operators.tiles import PIXEL, TILE, TILE_DAY
from emberframe.plans import super_fires as grow
from emberframe.session import scratch_path
from emberframe.sources import burn_points as csv_source
from emberframe.sources import samples as sample_source
from emberframe.sources import tile_index

TD = "year, tile_col, tile_row, dob"
TDP = TD + ", pixel_y, pixel_x"


def points(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "burn_points")


def located(spark: SparkSession, d: str) -> DataFrame:
    return tiles.locate(points(spark, d))


def fires_of(spark: SparkSession, d: str) -> DataFrame:
    return tiles.tile_fires(located(spark, d))


def _yearly_csv(spark: SparkSession, d: str) -> str:
    """Burn points as one CSV folder per year below the shared folder."""
    base = scratch_path(spark, "burn-points")
    wide = points(spark, d).select(
        F.col("id").alias("ID"), "lon", "lat", "fireday", "year", F.col("dob").cast("double").alias("DOB"),
        "firearea", "cumuarea", *[F.lit(0.0).alias(c) for c in csv_source.SCHEMA.names[8:]],
    )
    wide.withColumn("y", F.col("year")).write.partitionBy("y").option("header", True).csv(base)
    return base + "/y={year}"


CSV_COLUMNS = ("ID", "lon", "lat", "fireday", "year", "DOB", "firearea", "cumuarea")
CSV_ORACLE = """
SELECT id, count(*) AS n, min(fireday) AS first_day, max(dob) AS last_dob, sum(firearea) AS firearea,
       sum(cumuarea) AS cumuarea, max(lon) AS max_lon, min(lat) AS min_lat, count(*) AS places FROM burn_points {where} GROUP BY id"""


def _csv_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(
        F.count("*").alias("n"), F.min("fireday").alias("first_day"), F.max("dob").alias("last_dob"),
        F.sum("firearea").alias("firearea"), F.sum("cumuarea").alias("cumuarea"),
        F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.count_distinct("row_seq").alias("places"),
    )


@register("s1_read_burn_points", query(CSV_ORACLE.format(where="WHERE year = 1998"), "burn_points"))
def s1(spark, d):
    return _csv_summary(csv_source.read_burn_points(spark, _yearly_csv(spark, d), [1998], CSV_COLUMNS))


@register("s2_multi_year_concat", query(CSV_ORACLE.format(where=""), "burn_points"))
def s2(spark, d):
    # The years of the data and one that is absent.
    years = sorted(y for (y,) in points(spark, d).select("year").distinct().collect())
    return _csv_summary(csv_source.read_burn_points(spark, _yearly_csv(spark, d), [years[0] - 1, *years], CSV_COLUMNS))


INDEX_ORACLE = f"""
SELECT {TD}, id, fireday, cast(row_number() OVER (PARTITION BY {TD} ORDER BY first_seq) - 1 AS bigint) AS position
FROM fires"""


@register("s3_read_tile_fires_json", query(INDEX_ORACLE, "fires"))
def s3(spark, d):
    path = scratch_path(spark, "tile-fires")
    tile_index.write_tile_fires_json(tiles.pack_tile_fires(fires_of(spark, d)), path)
    return tile_index.read_tile_fires_json(spark, [path]).drop("source").withColumnRenamed("first_seq", "position")


@register(
    "s4_write_tile_fires_json",
    query(
        f"""SELECT 'tile_' || tile_col || '_' || tile_row || '_DOB_' || year || '_' || dob AS tile_key,
                   string_agg(id || ':' || 'day_' || lpad(cast(fireday AS varchar), 3, '0'), ',' ORDER BY first_seq) AS fires
            FROM fires GROUP BY {TD}""",
        "fires",
    ),
)
def s4(spark, d):
    path = scratch_path(spark, "tile-fires")
    tile_index.write_tile_fires_json(tiles.pack_tile_fires(fires_of(spark, d)), path)
    lines = spark.read.text(path).select(
        F.explode(F.from_json("value", f"map<string,{tile_index.ENTRY}>")).alias("tile_key", "f")
    )
    text = F.transform("f", lambda e: F.concat_ws(":", e["fire_id"], e["day_key"]))
    return lines.select("tile_key", F.array_join(text, ",").alias("fires"))


def _samples(spark, d) -> DataFrame:
    """Next-day samples with primary fire and a split by year."""
    fires = fires_of(spark, d)
    pairs = pairing.next_day_pairs(pairing.tile_days(fires))
    split_of = F.when(F.col("year") <= 1999, "train").when(F.col("year") == 2000, "val").otherwise("test")
    return pairs.join(tiles.primary_fire(fires), list(TILE_DAY)).withColumn("split", split_of)


SAMPLES_SQL = f"""SELECT p.*, f.id AS primary_fire, f.fireday AS primary_fireday,
    CASE WHEN p.year <= 1999 THEN 'train' WHEN p.year = 2000 THEN 'val' ELSE 'test' END AS split
    FROM pairs p JOIN (SELECT {TD}, arg_min(id, first_seq) AS id, arg_min(fireday, first_seq) AS fireday
                       FROM fires GROUP BY {TD}) f USING ({TD})"""


@register(
    "s8_sample_manifest",
    query(
        """SELECT split, 'sample_' || (row_number() OVER (PARTITION BY split ORDER BY year, dob, tile_col, tile_row) - 1)
                  || '.npz' AS sample, 'tile_' || tile_col || '_' || tile_row AS tile_id,
                  primary_fireday AS fireday, primary_fire AS primary_fire_id FROM samples""",
        "fires", "pairs", samples=SAMPLES_SQL,
    ),
)
def s8(spark, d):
    path = scratch_path(spark, "manifest")
    sample_source.write_manifest(sample_source.sample_manifest(_samples(spark, d)), path)
    return sample_source.read_manifest(spark, path)


@register("c1_project_lambert", query(f"SELECT row_seq, {R('easting', 2)} AS easting, {R('northing', 2)} AS northing FROM proj", "proj"))
def c1(spark, d):
    return rounded(geo.with_projection(points(spark, d)).select("row_seq", "easting", "northing"), "easting", "northing", digits=2)


# The twin states the identity: unprojecting what was projected gives the point back.
@register("c2_unproject_lambert", query(f"SELECT row_seq, {R('lon')} AS lon, {R('lat')} AS lat FROM burn_points", "burn_points"))
def c2(spark, d):
    lon, lat = geo.unproject_lambert(F.col("easting"), F.col("northing"))
    return geo.with_projection(points(spark, d)).select("row_seq", r(lon).alias("lon"), r(lat).alias("lat"))


@register(
    "c3_assign_tile",
    query("SELECT row_seq, 'tile_' || tile_col || '_' || tile_row AS tile_id, pixel_x, pixel_y FROM tiled", "tiled"),
)
def c3(spark, d):
    return located(spark, d).select("row_seq", geo.tile_id().alias("tile_id"), "pixel_x", "pixel_y")


def _keys(spark, d) -> DataFrame:
    return pairing.tile_days(fires_of(spark, d)).withColumn(
        "tile_key", geo.tile_key(geo.tile_id(), F.col("year"), F.col("dob"))
    )


KEY_SQL = "'tile_' || tile_col || '_' || tile_row || '_DOB_' || year || '_' || dob"


@register(
    "c4_parse_tile_key",
    query(f"SELECT {KEY_SQL} AS tile_key, 'tile_' || tile_col || '_' || tile_row AS tile_id, {TD} FROM days", "days"),
)
def c4(spark, d):
    parts = geo.parse_tile_key(F.col("tile_key"))
    return _keys(spark, d).select("tile_key", *[c.alias(n) for n, c in parts.items()])


@register(
    "c5_tile_and_day_keys",
    query(
        f"SELECT {KEY_SQL} AS tile_key, 'day_' || lpad(cast(fireday AS varchar), 3, '0') AS day_key, count(*) AS n FROM tiled GROUP BY ALL",
        "tiled",
    ),
)
def c5(spark, d):
    key = geo.tile_key(geo.tile_id(), F.col("year"), F.col("dob"))
    return located(spark, d).groupBy(key.alias("tile_key"), geo.day_key("fireday").alias("day_key")).agg(F.count("*").alias("n"))


@register(
    "c6_tile_bounds",
    query(
        """SELECT DISTINCT tile_col, tile_row, pixel_y, pixel_x, tile_col * 2304e1 AS min_x, (tile_row + 1) * 2304e1 AS max_y,
                  tile_col * 2304e1 + pixel_x * 9e1 AS origin_x, (tile_row + 1) * 2304e1 - pixel_y * 9e1 AS origin_y FROM tiled""",
        "tiled",
    ),
)
def c6(spark, d):
    col, row = F.col("tile_col"), F.col("tile_row")
    x, y = geo.cell_origin(col, row, F.col("pixel_x"), F.col("pixel_y"))
    b = geo.tile_bounds(col, row)
    cells = located(spark, d).select(*TILE, *PIXEL).distinct()
    return cells.withColumns({"min_x": b["min_x"], "max_y": b["max_y"], "origin_x": x, "origin_y": y})


@register(
    "c7_day_of_burn_dates",
    query(
        """SELECT year, dob, strftime(make_date(year, 1, 1) + (dob - 1), '%Y-%m-%d') AS burn_date,
                  cast(dayofyear(make_date(year, 1, 1) + (dob - 1)) AS int) AS dob_again, count(*) AS n
           FROM burn_points GROUP BY ALL""",
        "burn_points",
    ),
)
def c7(spark, d):
    date = timeops.dob_to_date(F.col("year"), F.col("dob"))
    return points(spark, d).groupBy("year", "dob").agg(F.count("*").alias("n")).withColumns(
        {"burn_date": date.cast("string"), "dob_again": timeops.date_to_dob(date)}
    )


def metadata(spark, d) -> DataFrame:
    return tiles.tile_day_metadata(located(spark, d), fixtures.load(spark, d, "tz_region"))


_FMT = "'%Y-%m-%dT%H:%M:%S'"


@register(
    "c8_local_day_to_utc",
    query(
        f"""SELECT id, tile_col, tile_row, fireday, cast(month AS int) AS month, strftime(start_utc, {_FMT}) AS start_utc,
                   strftime(end_utc, {_FMT}) AS end_utc, strftime(noon_utc, {_FMT}) AS noon_utc FROM meta""",
        "meta",
    ),
)
def c8(spark, d):
    times = {c: timeops.iso(F.col(c)) for c in ("start_utc", "end_utc", "noon_utc")}
    return metadata(spark, d).withColumns(times).select("id", *TILE, "fireday", "month", *times)


@register(
    "c26_expected_date",
    query("SELECT id, tile_col, tile_row, fireday, strftime(coalesce(noon_utc, start_utc, end_utc), '%Y-%m-%d') AS expected FROM meta", "meta"),
)
def c26(spark, d):
    date = timeops.expected_date(F.col("noon_utc"), F.col("start_utc"), F.col("end_utc"))
    return metadata(spark, d).select("id", *TILE, "fireday", date.cast("string").alias("expected"))


@register("j9_time_zone", query("SELECT id, tile_col, tile_row, fireday, tz FROM meta", "meta"))
def j9(spark, d):
    first = tiles.first_rows(located(spark, d))
    return tiles.with_time_zone(first, fixtures.load(spark, d, "tz_region")).select("id", *TILE, "fireday", "tz")


@register("w6_first_row", query(f"SELECT id, tile_col, tile_row, fireday, dob, {R('lon')} AS lon, {R('lat')} AS lat FROM firstrow", "firstrow"))
def w6(spark, d):
    return rounded(tiles.first_rows(located(spark, d)).drop("year"), "lon", "lat")


@register(
    "c12_binarise",
    query("SELECT id, count(*) FILTER (WHERE firearea > 0) AS burning, count(*) FILTER (WHERE cumuarea > 0) AS burned, count(*) AS n FROM burn_points GROUP BY id", "burn_points"),
)
def c12(spark, d):
    return points(spark, d).groupBy("id").agg(
        F.count_if(values.binarise(F.col("firearea"))).alias("burning"),
        F.count_if(values.binarise(F.col("cumuarea"))).alias("burned"), F.count("*").alias("n"),
    )


@register(
    "c28_fuel_vintage",
    query("SELECT year, CASE WHEN year > 2020 THEN '2020' ELSE '2015' END AS vintage, CASE WHEN year + 22 > 2020 THEN '2020' ELSE '2015' END AS later_vintage, count(*) AS n FROM burn_points GROUP BY ALL", "burn_points"),
)
def c28(spark, d):
    return points(spark, d).groupBy("year").agg(F.count("*").alias("n")).withColumns(
        {"vintage": timeops.fuel_vintage(F.col("year")), "later_vintage": timeops.fuel_vintage(F.col("year") + 22)}
    )


@register(
    "c30_fireday_channel",
    query(f"SELECT id, fireday, {R('CASE WHEN fireday - 5 > 0 THEN (fireday - 5) / 1e2 ELSE 0e0 END')} AS channel, count(*) AS n FROM burn_points GROUP BY ALL", "burn_points"),
)
def c30(spark, d):
    channel = values.fireday_channel(F.col("fireday") - 5)
    return points(spark, d).groupBy("id", "fireday").agg(F.count("*").alias("n")).withColumn("channel", r(channel))


def label_inputs(spark, d, history: bool = True):
    table = burn.burn_table(located(spark, d))
    fires, masks = tiles.tile_fires(table), burn.masks_of(table)
    return (
        fires, pairing.next_day_pairs(pairing.tile_days(fires)),
        burn.current_mask(fires, masks, history), burn.day_mask(fires, masks),
    )


@register(
    "c31_growth_label",
    query(
        f"""SELECT {TD}, count(*) FILTER (WHERE label = 1) AS old_pixels, count(*) FILTER (WHERE label = 2) AS new_pixels FROM (
              SELECT {TDP}, 2 AS label FROM grown
              UNION ALL SELECT {TDP}, 1 AS label FROM cur JOIN (SELECT {TD} FROM pairs) q USING ({TD})) u GROUP BY {TD}""",
        "grown", "cur",
    ),
)
def c31(spark, d):
    table = burn.burn_table(located(spark, d))
    fires = tiles.tile_fires(table)
    labels = burn.new_growth(fires, burn.masks_of(table), pairing.next_day_pairs(pairing.tile_days(fires)), classes=3)
    return labels.groupBy(*TILE_DAY).agg(
        F.count_if(F.col("label") == 1).alias("old_pixels"), F.count_if(F.col("label") == 2).alias("new_pixels")
    )


@register(
    "new_growth_per_tile_day",
    query(
        f"""SELECT p.year, p.tile_col, p.tile_row, p.dob, count(g.pixel_y) AS new_pixels
            FROM pairs p LEFT JOIN grown g USING ({TD}) GROUP BY ALL""",
        "grown",
    ),
)
def new_growth(spark, d):
    return burn.new_growth_counts(located(spark, d))


@register(
    "c33_fire_size",
    query(f"SELECT id, {R('(max(lat) - min(lat) + 1e-5) * (max(lon) - min(lon) + 1e-5)', 9)} AS fire_size FROM burn_points GROUP BY id", "burn_points"),
)
def c33(spark, d):
    e = tiles.extents(points(spark, d), "id")
    size = geo.fire_size(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    return e.select("id", r(size, 9).alias("fire_size"))


@register(
    "f1_keep_fires",
    query(
        f"""SELECT {TD}, id, fireday FROM fires WHERE id IN (SELECT id FROM burn_points GROUP BY id HAVING count(*) >= 85)""",
        "fires",
    ),
)
def f1(spark, d):
    pts = points(spark, d)
    ids = pts.groupBy("id").agg(F.count("*").alias("n")).where("n >= 85")
    return pairing.keep_fires(fires_of(spark, d), ids).select(*TILE_DAY, "id", "fireday")


@register("f2_only_fire", query("SELECT row_seq, lon, lat, dob FROM burn_points WHERE id = '1997_3'", "burn_points"))
def f2(spark, d):
    return tiles.only_fire(points(spark, d), "1997_3").select("row_seq", "lon", "lat", "dob")


@register(
    "f3_complete_tile_days",
    query(
        f"SELECT {TD} FROM (SELECT DISTINCT {TDP} FROM coarse) q GROUP BY {TD} HAVING count(*) = 4",
        "proj", coarse=tiling("proj", 2, 11520),
    ),
)
def f3(spark, d):
    coarse = tiles.locate(points(spark, d), grid=2, pixel=11520.0)
    return pairing.complete_tile_days(coarse.select(*TILE_DAY, *PIXEL).distinct(), 2)


BAD_SQL = f"SELECT {TD} FROM tiled GROUP BY {TD} HAVING max(cumuarea) = 5e1"


def _bad_days(spark, d) -> DataFrame:
    return located(spark, d).groupBy(*TILE_DAY).agg(F.max("cumuarea").alias("m")).where("m = 50").select(*TILE_DAY)


def _sequence_sql(inputs: str) -> str:
    near = lambda i, t: f"JOIN {t} d{i} ON d{i}.year = a.year AND d{i}.tile_col = a.tile_col AND d{i}.tile_row = a.tile_row AND d{i}.dob = a.dob + {i}"
    return f"""SELECT a.year, a.tile_col, a.tile_row, a.dob AS start_dob, a.dob + 3 AS target_dob
               FROM {inputs} a {near(1, inputs)} {near(2, inputs)} {near(3, 'days')}"""


@register(
    "f5_valid_sequences",
    query(_sequence_sql("clean"), "days", "tiled", bad=BAD_SQL, clean=f"SELECT * FROM days d WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.year = d.year AND b.tile_col = d.tile_col AND b.tile_row = d.tile_row AND b.dob = d.dob)"),
)
def f5(spark, d):
    days = pairing.tile_days(fires_of(spark, d))
    return pairing.sequences(pairing.pass_gate(days, _bad_days(spark, d)), 3, days)


@register("j1_next_day_pairs", query(f"SELECT {TD}, next_dob FROM pairs", "pairs"))
def j1(spark, d):
    return pairing.next_day_pairs(pairing.tile_days(fires_of(spark, d)))


@register("j2_sequences", query(_sequence_sql("days"), "days"))
def j2(spark, d):
    return pairing.sequences(pairing.tile_days(fires_of(spark, d)), 3)


@register(
    "j11_split_of_fires",
    query("SELECT m.id, m.super_id, s.split FROM members m JOIN split s USING (super_id)", "members", "split"),
)
def j11(spark, d):
    members, assigned = _split(spark, d)
    return split.split_fires(members, assigned)


@register(
    "j13_burned_until",
    query(
        f"""SELECT f.year, f.tile_col, f.tile_row, f.dob, f.id, count(*) AS pixels, cast(sum(b.first_fireday) AS bigint) AS days
            FROM fires f JOIN firstburn b USING (year, tile_col, tile_row, id) WHERE b.first_fireday <= f.fireday GROUP BY ALL""",
        "fires", "firstburn",
    ),
)
def j13(spark, d):
    loc = located(spark, d)
    rows = burn.burned_until(tiles.tile_fires(loc), burn.first_burn(burn.fire_day_masks(loc)))
    return rows.groupBy(*TILE_DAY, "id").agg(F.count("*").alias("pixels"), F.sum("first_fireday").alias("days"))


@register(
    "j14_primary_environment",
    query(
        f"""SELECT t.year, t.tile_col, t.tile_row, t.dob, t.id, count(*) AS n, sum(t.cumuarea) AS cumuarea
            FROM tiled t JOIN (SELECT {TD}, arg_min(id, first_seq) AS id, arg_min(fireday, first_seq) AS fireday FROM fires GROUP BY {TD}) p
            USING (year, tile_col, tile_row, dob, id, fireday) GROUP BY ALL""",
        "fires",
    ),
)
def j14(spark, d):
    loc = located(spark, d)
    kept = pairing.primary_environment(loc, tiles.primary_fire(tiles.tile_fires(loc)))
    return kept.groupBy(*TILE_DAY, "id").agg(F.count("*").alias("n"), F.sum("cumuarea").alias("cumuarea"))


@register(
    "j15_dense_scaffold",
    query(
        f"""SELECT {TD}, count(*) AS cells, count(*) FILTER (WHERE coalesce(burned, false)) AS burned,
                   cast(sum(CASE WHEN burned THEN y * 8 + x ELSE 0 END) AS bigint) AS checksum
            FROM (SELECT {TD}, y, x FROM days, (SELECT unnest(range(8)) AS y) ys, (SELECT unnest(range(8)) AS x) xs) c
            LEFT JOIN (SELECT {TD}, pixel_y AS y, pixel_x AS x, arg_max(firearea, row_seq) > 0 AS burned FROM coarse GROUP BY ALL) s
            USING ({TD}, y, x) GROUP BY {TD}""",
        "days", "proj", coarse=tiling("proj", 8, 2880),
    ),
)
def j15(spark, d):
    coarse = tiles.locate(points(spark, d), grid=8, pixel=2880.0)
    sparse = tiles.rasterise_last(coarse, {"burned": F.col("firearea") > 0}, (*TILE_DAY, *PIXEL))
    dense = tiles.dense_scaffold(pairing.tile_days(coarse), sparse, {"burned": False}, grid=8)
    return dense.groupBy(*TILE_DAY).agg(
        F.count("*").alias("cells"), F.count_if("burned").alias("burned"),
        F.sum(F.when(F.col("burned"), F.col("pixel_y") * 8 + F.col("pixel_x")).otherwise(0)).alias("checksum"),
    )


@register(
    "j16_day_key_for_dob",
    query("SELECT year, tile_col, tile_row, id, dob, min(fireday) AS fireday, 'day_' || lpad(cast(min(fireday) AS varchar), 3, '0') AS day_key FROM firstrow GROUP BY year, tile_col, tile_row, id, dob", "firstrow"),
)
def j16(spark, d):
    return tiles.day_key_for_dob(located(spark, d))


@register(
    "a1_rasterise_last",
    query(
        f"""SELECT tile_col, tile_row, id, fireday, pixel_y, pixel_x, arg_max(firearea, row_seq) > 0 AS firearea,
                   arg_max(cumuarea, row_seq) > 0 AS cumuarea,
                   {R('arg_max(easting, row_seq)', 1)} AS easting, {R('arg_max(lat, row_seq)', 4)} AS lat
            FROM tiled GROUP BY year, tile_col, tile_row, id, fireday, pixel_y, pixel_x""",
        "tiled",
    ),
)
def a1(spark, d):
    last = tiles.rasterise_last(
        located(spark, d),
        {"firearea": F.col("firearea") > 0, "cumuarea": F.col("cumuarea") > 0, "easting": F.col("easting"), "lat": F.col("lat")},
        ("year", *TILE, "id", "fireday", *PIXEL),
    )
    return last.withColumns({"easting": r("easting", 1), "lat": r("lat", 4)}).drop("year")


@register(
    "a2_tile_fires",
    query(f"SELECT {TD}, string_agg(id || ':' || fireday, ',' ORDER BY first_seq) AS fires FROM fires GROUP BY {TD}", "fires"),
)
def a2(spark, d):
    packed = tiles.pack_tile_fires(fires_of(spark, d))
    text = F.transform("fires", lambda f: F.concat_ws(":", f["fire_id"], f["fireday"].cast("string")))
    return packed.select(*TILE_DAY, F.array_join(text, ",").alias("fires"))


@register(
    "a3_overlap_summary",
    query(f"SELECT count(*) AS tile_days, count(*) FILTER (WHERE n > 1) AS overlapping, max(n) AS max_overlap FROM (SELECT count(*) AS n FROM fires GROUP BY {TD}) q", "fires"),
)
def a3(spark, d):
    return tiles.overlap_summary(fires_of(spark, d))


@register(
    "a4_fire_extent",
    query(
        "SELECT id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon, min(dob) AS first_dob, max(dob) AS last_dob, count(*) AS points FROM burn_points GROUP BY id",
        "burn_points",
    ),
)
def a4(spark, d):
    return tiles.extents(points(spark, d), "id").drop("center_lat", "center_lon")


def _super_stats(spark, d):
    members = graph.super_fires(fires_of(spark, d))
    return members, split.super_fire_stats(points(spark, d), members)


@register(
    "a5_super_fire_extent",
    query(f"SELECT super_id, min_lat, max_lat, min_lon, max_lon, {R('center_lat + 33e-9')} AS center_lat, {R('center_lon + 33e-9')} AS center_lon, {R('fire_size', 9)} AS fire_size FROM superstats", "superstats"),
)
def a5(spark, d):
    # The offset keeps averages of four-digit coordinates away from rounding ties.
    stats = _super_stats(spark, d)[1].withColumns({c: r(F.col(c) + 33e-9) for c in ("center_lat", "center_lon")})
    return stats.withColumn("fire_size", r("fire_size", 9))


@register("a7_quantile_bins", query("SELECT super_id, size_bin, lat_bin, lon_bin FROM binned", "binned"))
def a7(spark, d):
    binned = split.size_and_place_bins(_super_stats(spark, d)[1])
    return binned.select("super_id", "size_bin", "lat_bin", "lon_bin")


@register("a8_strata", query("SELECT stratum, count(*) AS n FROM stratified GROUP BY stratum", "stratified"))
def a8(spark, d):
    stats = _super_stats(spark, d)[1]
    return split.strata(split.size_and_place_bins(stats)).groupBy("stratum").agg(F.count("*").alias("n"))


def _split(spark, d):
    members, stats = _super_stats(spark, d)
    return members, split.stratified_split(split.strata(split.size_and_place_bins(stats)))


@register("m1_stratified_split", query("SELECT super_id, stratum, split FROM split", "split"))
def m1(spark, d):
    return _split(spark, d)[1].select("super_id", "stratum", "split")


# The same split with every fire as its own unit: hundreds of members, all strata in use.
@register(
    "m1_stratified_split_by_fire",
    query("SELECT super_id, stratum, split FROM split", "split").replace(
        "SELECT u AS id, min(v) AS super_id FROM reach GROUP BY u", "SELECT DISTINCT id, id AS super_id FROM burn_points"
    ),
)
def m1_by_fire(spark, d):
    pts = points(spark, d)
    alone = pts.select("id").distinct().withColumn("super_id", F.col("id"))
    stats = split.super_fire_stats(pts, alone)
    return split.stratified_split(split.strata(split.size_and_place_bins(stats))).select("super_id", "stratum", "split")


@register("g1_super_fires", query("SELECT id, super_id FROM members", "members"))
def g1(spark, d):
    return graph.super_fires(fires_of(spark, d))


@register("g1_incremental", query("SELECT id, super_id FROM members", "members"))
def g1_incremental(spark, d):
    """Months arrive in two runs; the second breaks off before its record and is repeated."""
    fires = fires_of(spark, d).withColumn("day", F.col("year") * 12 + F.floor(F.col("dob") / 31).cast("int"))
    path = scratch_path(spark, "super-fires")
    grow.add_pending(fires.where("day % 12 < 7"), path)
    grow.add_pending(fires, path, commit=False)
    grow.add_pending(fires, path)
    return grow.read_super_fires(spark, path)


@register(
    "a13_merge_masks",
    query(
        f"""SELECT {TD}, count(*) AS pixels, cast(sum(pixel_y * 256 + pixel_x) AS bigint) AS checksum FROM today GROUP BY {TD}""",
        "today",
    ),
)
def a13(spark, d):
    _, _, _, today = label_inputs(spark, d)
    return today.groupBy(*TILE_DAY).agg(
        F.count("*").alias("pixels"), F.sum(F.col("pixel_y") * 256 + F.col("pixel_x")).alias("checksum")
    )


CUR_SUMMARY = f"""SELECT {TD}, count(*) AS pixels, cast(sum(first_fireday) AS bigint) AS days,
    {R("sum(CASE WHEN first_fireday > 0 THEN first_fireday / 1e2 ELSE 0e0 END)", 4)} AS fireday_grid FROM cur GROUP BY {TD}"""


def _mask_summary(mask: DataFrame) -> DataFrame:
    return mask.groupBy(*TILE_DAY).agg(
        F.count("*").alias("pixels"), F.sum("first_fireday").alias("days"), r(F.sum("fireday_grid"), 4).alias("fireday_grid")
    )


@register("a14_first_burn", query(CUR_SUMMARY, "cur"))
def a14(spark, d):
    return _mask_summary(label_inputs(spark, d)[2])


@register(
    "a14_current_day_only",
    query(
        CUR_SUMMARY, "fires", "masks",
        cur="""SELECT f.year, f.tile_col, f.tile_row, f.dob, m.pixel_y, m.pixel_x, arg_min(m.fireday, f.first_seq) AS first_fireday
               FROM fires f JOIN masks m USING (year, tile_col, tile_row, id, fireday) GROUP BY ALL""",
    ),
)
def a14_day(spark, d):
    return _mask_summary(label_inputs(spark, d, history=False)[2])


@register(
    "a22_retained_fires",
    query(
        f"""SELECT DISTINCT f.id FROM fires f JOIN (SELECT {TD} FROM pairs UNION SELECT year, tile_col, tile_row, next_dob FROM pairs) q USING ({TD})""",
        "fires", "pairs",
    ),
)
def a22(spark, d):
    fires = fires_of(spark, d)
    return pairing.retained_fires(fires, pairing.next_day_pairs(pairing.tile_days(fires)))


@register(
    "a23_split_counts",
    query("SELECT split, count(*) AS samples, count(DISTINCT primary_fire) AS fires FROM samples GROUP BY split", "fires", "pairs", samples=SAMPLES_SQL),
)
def a23(spark, d):
    return pairing.sample_counts(_samples(spark, d).withColumnRenamed("primary_fire", "id"))


@register("a26_active_days", query("SELECT DISTINCT id, tile_col, tile_row, dob FROM tiled", "tiled"))
def a26(spark, d):
    return tiles.active_days(located(spark, d), "id", *TILE, "dob")


@register(
    "w4_running_mask",
    query(
        f"""SELECT year, tile_col, tile_row, dob, count(*) AS cells, count(*) FILTER (WHERE so_far) AS burned FROM (
              SELECT *, max(burned) OVER (PARTITION BY year, tile_col, tile_row, pixel_y, pixel_x ORDER BY dob) AS so_far
              FROM (SELECT {TDP}, bool_or(firearea > 0) AS burned FROM tiled GROUP BY ALL) q) u GROUP BY {TD}""",
        "tiled",
    ),
)
def w4(spark, d):
    daily = located(spark, d).groupBy(*TILE_DAY, *PIXEL).agg(F.bool_or(F.col("firearea") > 0).alias("burned"))
    rows = burn.running_mask(daily, ("year", *TILE, *PIXEL), "dob", "burned")
    return rows.groupBy(*TILE_DAY).agg(F.count("*").alias("cells"), F.count_if("burned_so_far").alias("burned"))


@register(
    "w10_fire_and_day_order",
    query(
        f"""SELECT {TD}, id, fireday, row_number() OVER (PARTITION BY {TD} ORDER BY first_seq) AS fire_ord,
                   dense_rank() OVER (PARTITION BY year, tile_col, tile_row, id ORDER BY fireday) AS day_ord FROM fires""",
        "fires",
    ),
)
def w10(spark, d):
    return tiles.fire_order(fires_of(spark, d)).drop("first_seq").withColumns(
        {c: F.col(c).cast("bigint") for c in ("fire_ord", "day_ord")}
    )


@register(
    "w11_last_frame",
    query(
        """SELECT year, tile_col, tile_row, start_dob, count(*) AS pixels, sum(cumuarea) AS cumuarea FROM (
             SELECT s.year, s.tile_col, s.tile_row, s.start_dob, v.pixel_y, v.pixel_x, arg_max(v.cumuarea, v.dob) AS cumuarea
             FROM seqs s JOIN vals v ON v.year = s.year AND v.tile_col = s.tile_col AND v.tile_row = s.tile_row
                  AND v.dob BETWEEN s.start_dob AND s.start_dob + 2 GROUP BY ALL) q GROUP BY ALL""",
        "days", "tiled", seqs=_sequence_sql("days"),
        vals=f"SELECT {TDP}, arg_max(cumuarea, row_seq) AS cumuarea FROM tiled GROUP BY {TDP}",
    ),
)
def w11(spark, d):
    loc = located(spark, d)
    starts = pairing.sequences(pairing.tile_days(loc), 3).select("year", *TILE, "start_dob")
    pixel_days = tiles.rasterise_last(loc, {"cumuarea": F.col("cumuarea")}, (*TILE_DAY, *PIXEL))
    last = burn.last_frames(pixel_days, 3, "cumuarea").groupBy("year", *TILE, "start_dob")
    frames = last.agg(F.count("*").alias("pixels"), F.sum("cumuarea").alias("cumuarea"))
    return frames.join(starts, ["year", *TILE, "start_dob"], "left_semi")


@register("l1_sorted_ids", query("SELECT DISTINCT id FROM burn_points ORDER BY id", "burn_points"))
def l1(spark, d):
    return points(spark, d).select("id").distinct().orderBy("id")


@register("l2_first_k", query("SELECT id, n FROM (SELECT id, count(*) AS n FROM burn_points GROUP BY id) q ORDER BY id LIMIT 100", "burn_points"))
def l2(spark, d):
    return sampling.first_k(points(spark, d).groupBy("id").agg(F.count("*").alias("n")), ["id"], 100)


@register("u1_union_years", query("SELECT year, id, count(*) AS n FROM burn_points GROUP BY year, id", "burn_points"))
def u1(spark, d):
    pts = points(spark, d)
    years = sorted(y for (y,) in pts.select("year").distinct().collect())
    yearly = csv_source.union_years([pts.where(F.col("year") == y) for y in years])
    return yearly.groupBy("year", "id").agg(F.count("*").alias("n"))


@register(
    "u2_later_source_wins",
    query(
        f"""SELECT {TD}, id, fireday FROM hot UNION ALL
            SELECT f.year, f.tile_col, f.tile_row, f.dob, f.id, f.fireday FROM fires f
            WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.year = f.year AND h.tile_col = f.tile_col AND h.tile_row = f.tile_row AND h.dob = f.dob)""",
        "fires", hot=f"SELECT DISTINCT {TD}, id, fireday FROM tiled WHERE firearea > 45",
    ),
)
def u2(spark, d):
    loc = located(spark, d)
    both = tiles.tile_fires(loc).withColumn("source", F.lit(0)).unionByName(
        tiles.tile_fires(loc.where("firearea > 45")).withColumn("source", F.lit(1))
    )
    return tile_index.later_source_wins(both).drop("first_seq")


@register(
    "u3_union_of_ids",
    query(
        f"""SELECT id FROM fires JOIN pairs USING ({TD}) UNION
            SELECT f.id FROM fires f JOIN pairs p ON f.year = p.year AND f.tile_col = p.tile_col AND f.tile_row = p.tile_row AND f.dob = p.next_dob""",
        "fires", "pairs",
    ),
)
def u3(spark, d):
    fires = fires_of(spark, d)
    pairs = pairing.next_day_pairs(pairing.tile_days(fires))
    inputs = fires.join(pairs, list(TILE_DAY), "left_semi").select("id")
    target_days = pairs.select("year", *TILE, F.col("next_dob").alias("dob"))
    return inputs.union(fires.join(target_days, list(TILE_DAY), "left_semi").select("id")).distinct()


# A split that ignores overlaps leaks; the tests check that the grouped split does not.
NAIVE = "CASE WHEN cast(split_part(id, '_', 2) AS int) % 10 < 7 THEN 'train' WHEN cast(split_part(id, '_', 2) AS int) % 10 = 7 THEN 'val' ELSE 'test' END"


@register(
    "u4_leakage_check",
    query(f"SELECT {TD} FROM (SELECT {TD}, {NAIVE} AS split FROM fires) q GROUP BY {TD} HAVING count(DISTINCT split) > 1", "fires"),
)
def u4(spark, d):
    fires = fires_of(spark, d)
    n = F.split("id", "_")[1].cast("int") % 10
    naive = fires.select("id").distinct().withColumn(
        "split", F.when(n < 7, "train").when(n == 7, "val").otherwise("test")
    )
    return split.leaks(fires, naive)
