"""Queries that run whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.catalog import fixtures
from emberframe.catalog.environment import HOURLY_SQL, ROLLING_SQL, mosaic_cells
from emberframe.catalog.pixels import DAY, SIDE, raster
from emberframe.catalog.points import TD, located, points
from emberframe.catalog.registry import r, register, rounded
from emberframe.catalog.sql import CTES, R, num, query, tiling
from emberframe.catalog.sql import _CONE as CONE
from emberframe.functions import provenance, timeops
from emberframe.operators import pairing, ranking, split, tiles
from emberframe.operators.tiles import PIXEL, TILE
from emberframe.plans import baseline, feature_build, materialise, sample_build
from emberframe.session import cut_lineage, scratch_path
from emberframe.sources import samples as sample_source

JAN = "SELECT id, 2024 AS year, dob - 149 AS dob, fireday, lon, lat, firearea, cumuarea, row_seq, easting, northing FROM proj"
_T = f"pow(sqrt(x * x + y * y) / {num(CONE['scale'])}, {num(1 / CONE['n'])})"
_PHI = "pi() / 2 - 2 * atan(t)"
for _ in range(5):
    _PHI = f"pi() / 2 - 2 * atan(t * exp({num(-k.GRS80_E)} * atanh({num(k.GRS80_E)} * sin({_PHI}))))"
LATTICE_SQL = f"""SELECT tile_col, tile_row, py, px, e, n, degrees(atan2(x, y) / {num(CONE['n'])}) + {num(k.ORIGIN_LON_DEG)} AS lon, degrees({_PHI}) AS lat
    FROM (SELECT *, {_T} AS t FROM (SELECT *, e - {num(k.FALSE_EASTING)} AS x, {num(k.FALSE_NORTHING + CONE['rho0'])} - n AS y FROM (
      SELECT tile_col, tile_row, py, px, tile_col * 2304e1 + px * 288e1 AS e, (tile_row + 1) * 2304e1 - py * 288e1 AS n
      FROM (SELECT DISTINCT tile_col, tile_row FROM coarse) t, (SELECT unnest(range(8)) AS py) a, (SELECT unnest(range(8)) AS px) b) q1) q2) q3"""
# The primary fire decides the composite floor; weather is read at UTC noon + 1 h of its time zone.
E1_SQL = f"""
SELECT d.tile_col, d.tile_row, d.dob, count(*) AS cells, count(*) FILTER (WHERE b.burned) AS burned,
       count(*) FILTER (WHERE b.growing) AS growing, strftime(max(p.time_start), '%Y-%m-%d') AS composite,
       count(w.t2m) AS weather_cells, {R('sum(sqrt(w.u10 * w.u10 + w.v10 * w.v10) * 36e-1)', 4)} AS ws, {R('sum(v.ndvi)', 3)} AS ndvi, {R('sum(s.v)', 5)} AS dem
FROM prim d JOIN lattice l USING (tile_col, tile_row)
LEFT JOIN picked p ON p.tile_col = d.tile_col AND p.tile_row = d.tile_row AND p.dob = d.dob
LEFT JOIN veg_composite v ON v.time_start = p.time_start AND v.cell = least(greatest(cast(floor(58e0 - l.lat) AS int), 0), 1) * 4 + least(greatest(cast(floor(l.lon + 124e0) AS int), 0), 3)
LEFT JOIN mosaic s ON s.ix = least(greatest(cast(floor((l.e - 43e5) / 2e3 + 5e-1) AS bigint), 0), (SELECT max(ix) FROM mosaic))
      AND s.iy = least(greatest(cast(floor((l.n - 25e5) / 2e3 + 5e-1) AS bigint), 0), (SELECT max(iy) FROM mosaic))
LEFT JOIN (SELECT *, floor(latitude / 1e-1 + 5e-1) AS cy, floor(longitude / 1e-1 + 5e-1) AS cx FROM rolling) w
      ON w.cy = floor(l.lat / 1e-1 + 5e-1) AND w.cx = floor(l.lon / 1e-1 + 5e-1) AND w.valid_time = d.noon + INTERVAL 1 HOUR
     AND l.lat BETWEEN (SELECT min(latitude) FROM rolling) AND (SELECT max(latitude) FROM rolling)
     AND l.lon BETWEEN (SELECT min(longitude) FROM rolling) AND (SELECT max(longitude) FROM rolling)
LEFT JOIN (SELECT tile_col, tile_row, dob, pixel_y, pixel_x, bool_or(c) AS burned, bool_or(f) AS growing FROM (
        SELECT tile_col, tile_row, dob, id, fireday, pixel_y, pixel_x, arg_max(cumuarea, row_seq) > 0 AS c, arg_max(firearea, row_seq) > 0 AS f
        FROM coarse GROUP BY ALL) w0 GROUP BY ALL) b
      ON b.tile_col = d.tile_col AND b.tile_row = d.tile_row AND b.dob = d.dob AND b.pixel_y = l.py AND b.pixel_x = l.px
GROUP BY d.tile_col, d.tile_row, d.dob"""


@register(
    "e1_feature_build",
    query(
        E1_SQL, "proj", "weather_hourly", "veg_composite", "raster", "tz_region",
        january=JAN, coarse=tiling("january", 8, 2880), lattice=LATTICE_SQL, hourly=HOURLY_SQL, rolling=ROLLING_SQL,
        mosaic="SELECT (vec_id % 20) * 8 + pixel_x AS ix, cast(floor(vec_id / 20e0) AS bigint) * 8 + pixel_y AS iy, v FROM raster",
        prim="""SELECT q.*, timezone('UTC', timezone(coalesce(z.name, 'UTC'), cast(make_date(2024, 1, 1) + (dob - 1) AS timestamp) + INTERVAL 12 HOUR)) AS noon
                FROM (SELECT tile_col, tile_row, dob, arg_min(id, first_seq) AS id, arg_min(lon, first_seq) AS lon, arg_min(lat, first_seq) AS lat FROM (
                        SELECT tile_col, tile_row, dob, id, fireday, min(row_seq) AS first_seq, arg_min(lon, row_seq) AS lon, arg_min(lat, row_seq) AS lat FROM coarse GROUP BY ALL) g
                      GROUP BY ALL) q LEFT JOIN tz_region z ON q.lon >= z.lon_min AND q.lon < z.lon_max AND q.lat >= z.lat_min AND q.lat < z.lat_max""",
        picked="""SELECT d.tile_col, d.tile_row, d.dob, CASE WHEN max(v.time_start) >= make_date(2024, 1, 1) + (f.first - 6) THEN max(v.time_start) END AS time_start
                FROM prim d JOIN (SELECT id, min(dob) AS first FROM coarse GROUP BY id) f USING (id)
                LEFT JOIN (SELECT DISTINCT time_start FROM veg_composite) v ON v.time_start + 4 <= make_date(2024, 1, 1) + (d.dob - 1)
                GROUP BY d.tile_col, d.tile_row, d.dob, f.first""",
    ),
)
def e1(spark, d):
    """Feature build on a coarse lattice (8 x 8 cells of 2 880 m per tile), all points in one January."""
    pts = points(spark, d).withColumns({"year": F.lit(2024), "dob": F.col("dob") - 149})
    inputs = feature_build.Inputs(
        points=pts, tz_regions=fixtures.load(spark, d, "tz_region"), weather_hourly=fixtures.load(spark, d, "weather_hourly"),
        composites=fixtures.load(spark, d, "veg_composite"), statics=mosaic_cells(spark, d).withColumnRenamed("v", "dem"),
        static_origin=(4.3e6, 2.5e6), static_step=2e3, grid=8, pixel=2880.0,
        vegetation_grid=(-124.0, 58.0, 1.0), composite_days=4, composite_lookback=6,
    )
    dense = feature_build.build(inputs)
    return dense.groupBy("tile_col", "tile_row", "dob").agg(
        F.count("*").alias("cells"), F.count_if("cumuarea").alias("burned"), F.count_if("firearea").alias("growing"),
        F.max("time_start").cast("string").alias("composite"), F.count("rh").alias("weather_cells"),
        r(F.sum("ws"), 4).alias("ws"),
        r(F.sum("ndvi"), 3).alias("ndvi"), r(F.sum("dem"), 5).alias("dem"),
    )


DAY_SPLIT = f"""SELECT DISTINCT {TD}, s.split FROM fires JOIN members USING (id) JOIN split s USING (super_id)"""
# A sample needs a fire of its own split on both days.
E2_SQL = f"""SELECT p.split, count(*) AS samples, cast(coalesce(sum(n), 0) AS bigint) AS new_pixels FROM
    (SELECT a.* FROM dayset a WHERE EXISTS (SELECT 1 FROM dayset b WHERE b.year = a.year AND b.tile_col = a.tile_col
       AND b.tile_row = a.tile_row AND b.dob = a.dob + 1 AND b.split = a.split)) p
    LEFT JOIN (SELECT {TD}, count(*) AS n FROM grown GROUP BY {TD}) g USING ({TD}) GROUP BY p.split"""


@register("e2_sample_build", query(E2_SQL, "pairs", "members", "split", "grown", dayset=DAY_SPLIT))
def e2(spark, d):
    index = sample_build.index_samples(located(spark, d))
    return sample_build.summary(index, sample_build.next_day_labels(index))


E2_SEQ_SQL = f"""SELECT q.split, count(*) AS samples, cast(coalesce(sum(n), 0) AS bigint) AS new_pixels FROM
    (SELECT a.* FROM dayset a WHERE (SELECT count(*) FROM dayset b WHERE b.year = a.year AND b.tile_col = a.tile_col
       AND b.tile_row = a.tile_row AND b.split = a.split AND b.dob BETWEEN a.dob + 1 AND a.dob + 3) = 3) q
    LEFT JOIN (SELECT year, tile_col, tile_row, dob - 2 AS dob, count(*) AS n FROM grown GROUP BY ALL) g USING ({TD}) GROUP BY q.split"""


# Fires relay each other: every three days another one burns on in the same tile, so that neighbouring days
# belong to different super-fires and often to different splits.
RELAY = "SELECT * EXCLUDE (id), id || '_' || cast(cast(floor(dob / 3e0) AS int) AS varchar) AS id FROM (" + fixtures.sql("burn_points") + ") b0"
# Only fires of a tile-day that has a neighbouring day are kept before fires are grouped.
KEPT = f"""WITH f0 AS ({CTES['fires'][1]}), used AS (SELECT DISTINCT {TD} FROM f0 a WHERE EXISTS (SELECT 1 FROM f0 b
    WHERE b.year = a.year AND b.tile_col = a.tile_col AND b.tile_row = a.tile_row AND abs(b.dob - a.dob) = 1))
    SELECT * FROM f0 WHERE id IN (SELECT id FROM f0 JOIN used USING ({TD}))"""
E2_PURE_SQL = f"""SELECT a.split, count(*) AS day_pairs, count(*) FILTER (WHERE b.split = a.split) AS samples,
    count(*) FILTER (WHERE b.split <> a.split) AS crossing, cast(0 AS bigint) AS leaking
    FROM dayset a JOIN dayset b ON b.year = a.year AND b.tile_col = a.tile_col AND b.tile_row = a.tile_row AND b.dob = a.dob + 1
    GROUP BY a.split"""


def relay_points(spark, d):
    return points(spark, d).withColumn("id", F.concat_ws("_", "id", F.floor(F.col("dob") / 3).cast("int").cast("string")))


@register(
    "e2_split_purity",
    query(E2_PURE_SQL, "pairs", "members", "split", instead={"burn_points": RELAY, "fires": KEPT}, dayset=DAY_SPLIT),
)
def e2_split_purity(spark, d):
    """Neighbouring days of a tile, the samples made of them, those that cross splits, and samples that leak."""
    index = sample_build.index_samples(tiles.locate(relay_points(spark, d)))
    days = sample_build.split_days(index.fires)
    other = days.select("year", "tile_col", "tile_row", (F.col("dob") - 1).alias("dob"), F.col("split").alias("next_split"))
    every = days.join(other, ["year", "tile_col", "tile_row", "dob"]).groupBy("split").agg(
        F.count("*").alias("day_pairs"), F.count_if(F.col("split") != F.col("next_split")).alias("crossing")
    )
    made = index.pairs.groupBy("split").agg(F.count("*").alias("samples"))
    leaking = split.crossing_pairs(index.fires, index.pairs).groupBy("split").agg(F.count("*").alias("leaking"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(made, "split", "left").join(leaking, "split", "left").select(
        "split", "day_pairs", zero("samples"), "crossing", zero("leaking")
    )


@register("e2_sequence_build", query(E2_SEQ_SQL, "days", "members", "split", "grown", dayset=DAY_SPLIT))
def e2_sequences(spark, d):
    index = sample_build.index_samples(located(spark, d))
    sequences = sample_build.sequence_samples(index)
    labels = sample_build.sequence_labels(index, sequences)
    keys = ["year", "tile_col", "tile_row", "start_dob"]
    pixels = labels.groupBy(*keys).agg(F.count("*").alias("n"))
    return sequences.join(pixels, keys, "left").groupBy("split").agg(
        F.count("*").alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("new_pixels")
    )


@register(
    "e2_sequence_channels",
    query(
        f"""SELECT a.label, a.dob AS start_dob, s.step, {R('sum(r.v * (r.pixel_y * 8 + r.pixel_x + 1))')} AS tmax
            FROM numbered a JOIN (SELECT unnest(range(3)) AS step) s ON true
            JOIN numbered b ON b.label = a.label AND b.dob = a.dob + s.step JOIN raster r ON r.vec_id = b.vec_id
            WHERE EXISTS (SELECT 1 FROM numbered t WHERE t.label = a.label AND t.dob = a.dob + 3) GROUP BY ALL""",
        "raster", numbered="SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS dob FROM (SELECT DISTINCT vec_id, label FROM raster) q",
    ),
)
def e2_sequence_channels(spark, d):
    """Sequences of patches: the label is the tile, the order of the patch within it the day."""
    numbered = raster(spark, d).select("vec_id", "label").distinct()
    numbered = ranking.rank_by_prefix(
        numbered.withColumn("block", F.floor(F.col("vec_id") / 64)), ["block"], ["vec_id"], "dob", group=["label"]
    ).select("vec_id", "label", F.col("dob").cast("int").alias("dob"))
    channels = raster(spark, d).join(numbered, ["vec_id", "label"]).select("label", "dob", "pixel_y", "pixel_x", F.col("v").alias("tmax"))
    days = numbered.select(F.lit(2024).alias("year"), F.col("label").alias("tile_col"), F.lit(0).alias("tile_row"), "dob")
    starts = pairing.sequences(days, 3).select(F.col("tile_col").alias("label"), "start_dob")
    frames = sample_build.sequence_channels(starts, channels, 3, ("label",))
    weight = F.col("pixel_y") * 8 + F.col("pixel_x") + 1
    return frames.groupBy("label", "start_dob", "step").agg(r(F.sum(F.col("tmax") * weight)).alias("tmax"))


@register("e3_logistic_baseline")
def e3(spark, d):
    """Fitted model, so rows only: test metrics of the selected model."""
    split = F.when(F.col("label") < 7, "train").when(F.col("label") == 7, "val").otherwise("test")
    cells = raster(spark, d).select(
        *DAY, split.alias("split"), "pixel_y", "pixel_x", (F.col("v") * F.col("v")).alias("tmax"),
        F.sin(F.col("v") * 3).alias("rh"), (F.col("v") > 0.05).cast("int").alias("label"),
    )
    config = baseline.BaselineConfig(["tmax", "rh"], DAY, SIDE, max_positive=3000, w_values=[1.0, 2.0], max_iter=10)
    _, test = baseline.run(cells, config)
    return rounded(test, "iou", "dice", "precision", "recall", "accuracy", "auc_pr", "average_precision", digits=4)


# ---- samples as arrays, on tiles of 8 x 8 cells; each tile-day takes one patch, each tile another ----
_PATCHES = "(SELECT count(DISTINCT vec_id) FROM raster)"
COARSE = {"tiled": tiling("proj", 8, 2880)}
_ENV = f"""SELECT {TD}, r.pixel_y, r.pixel_x, CASE WHEN r.v > -36e-2 THEN r.v END AS g
    FROM (SELECT DISTINCT {TD} FROM tiled) t JOIN raster r ON r.vec_id = (tile_col * 31 + tile_row * 17 + dob) % {_PATCHES}"""
_FIXED = f"""SELECT tile_col, tile_row, r.pixel_y, r.pixel_x, 1e1 * r.v AS f
    FROM (SELECT DISTINCT tile_col, tile_row FROM tiled) t JOIN raster r ON r.vec_id = (tile_col * 13 + tile_row * 7) % {_PATCHES}"""
# Fires of input days that pass the gate and of the days after them.
GATED = f"""WITH f0 AS ({CTES['fires'][1]}), good AS (SELECT DISTINCT {TD} FROM f0 ANTI JOIN bad USING ({TD})),
    pair AS (SELECT a.* FROM good a WHERE EXISTS (SELECT 1 FROM f0 b WHERE b.year = a.year AND b.tile_col = a.tile_col
       AND b.tile_row = a.tile_row AND b.dob = a.dob + 1)),
    used AS (SELECT * FROM pair UNION SELECT year, tile_col, tile_row, dob + 1 AS dob FROM pair)
    SELECT * FROM f0 WHERE id IN (SELECT id FROM f0 JOIN used USING ({TD}))"""
_BASE = {"tiled": COARSE["tiled"], "fires": GATED}
_STATS = f"""SELECT avg(g) AS gm, stddev_pop(g) + 1e-8 AS gs FROM env JOIN (SELECT DISTINCT {TD} FROM dayset WHERE split = 'train') d USING ({TD})
    ANTI JOIN bad USING ({TD})"""
_STATIC_STATS = f"""SELECT avg(f) AS fm, stddev_pop(f) + 1e-8 AS fs FROM fixed JOIN (SELECT DISTINCT tile_col, tile_row FROM
    (SELECT DISTINCT {TD} FROM dayset WHERE split = 'train') d ANTI JOIN bad USING ({TD})) t USING (tile_col, tile_row)"""
_CHANNELS = f"""SELECT e.*, (g - gm) / gs AS tmax, g * 7 AS evi, g * 15 * 1e-4 AS s2_scl, (f - fm) / fs AS dem, sin(radians(3 * f)) AS aspect_sin,
    CASE WHEN c.first_fireday IS NULL THEN 0 ELSE 1 END AS burned, coalesce(c.first_fireday, 0) / 1e2 AS fireday
    FROM env e JOIN fixed USING (tile_col, tile_row, pixel_y, pixel_x) LEFT JOIN cur c USING ({TD}, pixel_y, pixel_x), moving, still"""
_ARRAYS = ("tmax", "evi", "s2_scl", "dem", "aspect_sin", "previous_burn_mask", "fireday_grid")


def materialise_inputs(spark, d):
    """Index, dense environment, statics, gate and imagery age of the coarse tiles."""
    place = tiles.locate(points(spark, d), 8, 2880.0)
    patches = fixtures.load(spark, d, "raster").select(F.col("vec_id").alias("_id"), *PIXEL, "v")
    n = patches.agg(F.count_distinct("_id").alias("n")).scalar()
    days = place.select("year", *TILE, "dob").distinct()
    of = lambda df, value: df.withColumn("_id", F.pmod(value, n)).join(patches, "_id").drop("_id")
    g = F.when(F.col("v") > -0.36, F.col("v"))
    environment = of(days, F.col("tile_col") * 31 + F.col("tile_row") * 17 + F.col("dob")).select(
        "year", *TILE, "dob", *PIXEL, *[(g * (i + 1)).alias(c) for i, c in enumerate(k.DYNAMIC_FEATURES)]
    )
    statics = of(days.select(*TILE).distinct(), F.col("tile_col") * 13 + F.col("tile_row") * 7).select(
        *TILE, *PIXEL, *[(F.col("v") * 10 * (i + 1)).alias(c) for i, c in enumerate(k.STATIC_FEATURES)]
    )
    environment, statics = cut_lineage(environment, "environment"), cut_lineage(statics, "statics")
    gate = cut_lineage(materialise.bad_days(environment, statics), "bad-days")
    return sample_build.index_samples(place, gate), environment, statics, gate, days


def _plane(x, name: str, cells: int = 64):
    """Sum of a channel, its cells weighted by their place."""
    at = k.CHANNELS.index(name) * cells
    part = F.slice(x, at + 1, cells)
    return F.aggregate(F.transform(part, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)


_SUMS = ", ".join(
    f"{R(f'sum(CAST({c} AS FLOAT)::DOUBLE * (pixel_y * 8 + pixel_x + 1))', 2)} AS {n}"
    for c, n in zip(("tmax", "evi", "s2_scl", "dem", "aspect_sin", "burned", "fireday"), _ARRAYS)
)


@register(
    "e2_materialise_samples",
    query(
        f"""SELECT p.split, {TD}, {_SUMS}, count(*) FILTER (WHERE w.dob IS NOT NULL) AS label,
                   (SELECT coalesce(min(cast(cast(make_date(p.year, 1, 1) + (p.dob - 1) AS date) - s.acq_date AS int)), 0) FROM scene s
                    WHERE s.tile_no = (p.tile_col * 7 + p.tile_row) % 20
                      AND s.acq_date BETWEEN cast(make_date(p.year, 1, 1) + (p.dob - 31) + 1 AS date) AND cast(make_date(p.year, 1, 1) + (p.dob - 1) AS date)) AS delta_t
            FROM (SELECT a.* FROM dayset a ANTI JOIN bad USING ({TD}) WHERE EXISTS (SELECT 1 FROM dayset b WHERE b.year = a.year
                    AND b.tile_col = a.tile_col AND b.tile_row = a.tile_row AND b.dob = a.dob + 1 AND b.split = a.split)) p
            JOIN channels USING ({TD}) LEFT JOIN (SELECT DISTINCT {TD}, pixel_y, pixel_x FROM grown) w USING ({TD}, pixel_y, pixel_x)
            GROUP BY p.split, {TD}, p.year, p.tile_col, p.tile_row, p.dob""",
        "raster", "scene", "tiled", "env", "bad", "pairs", "members", "split", "cur", "grown", "dayset", "fixed", "moving", "still", "channels",
        instead=_BASE, env=_ENV, bad=f"SELECT DISTINCT {TD} FROM env WHERE g IS NULL", dayset=DAY_SPLIT, fixed=_FIXED,
        moving=_STATS, still=_STATIC_STATS, channels=_CHANNELS,
    ),
)
def e2_materialise_samples(spark, d):
    """Samples written as arrays and read back: a checksum of some channels, labels and imagery age per sample."""
    index, environment, statics, gate, days = materialise_inputs(spark, d)
    expected = timeops.dob_to_date(F.col("year"), F.col("dob"))
    seen = fixtures.load(spark, d, "scene").groupBy("tile_no", "acq_date").agg(F.min("cloud_cover").alias("cloud_cover"))
    seen = seen.withColumn("burn_date", F.explode(F.expr("sequence(acq_date, date_add(acq_date, 29))"))).groupBy("tile_no", "burn_date").agg(
        F.collect_list(F.struct(F.lit(1.0).alias("pixels_pct"), "cloud_cover", F.col("acq_date").cast("string").alias("acquisition_date"))).alias("stats")
    )
    placed = days.withColumns({"tile_no": F.pmod(F.col("tile_col") * 7 + F.col("tile_row"), F.lit(20)), "burn_date": expected})
    age = placed.join(seen, ["tile_no", "burn_date"], "left").withColumn("delta_t", provenance.sat_age_days(F.col("burn_date"), F.col("stats")))
    path = scratch_path(spark, "samples")
    sample_source.export_samples(materialise.samples(index, environment, statics, gate, age), path)
    back = spark.read.parquet(path)
    return back.select(
        "split", "year", *TILE, "dob", *[r(_plane(F.col("x"), c), 2).alias(c) for c in _ARRAYS],
        F.aggregate("y", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("label"), F.col("delta_t").cast("int").alias("delta_t"),
    )


@register(
    "e2_materialise_sequences",
    query(
        f"""SELECT q.split, q.year, q.tile_col, q.tile_row, q.dob AS start_dob, s.step, {R('sum(CAST(tmax AS FLOAT)::DOUBLE * (pixel_y * 8 + pixel_x + 1))', 2)} AS tmax,
                   {R('sum(CAST(burned AS FLOAT)::DOUBLE * (pixel_y * 8 + pixel_x + 1))', 2)} AS previous_burn_mask, q.dob + s.step AS position,
                   (SELECT count(*) FROM (SELECT DISTINCT {TD}, pixel_y, pixel_x FROM grown) w WHERE w.year = q.year AND w.tile_col = q.tile_col AND w.tile_row = q.tile_row AND w.dob = q.dob + 2) AS label
            FROM (SELECT a.* FROM dayset a ANTI JOIN bad USING ({TD}) WHERE (SELECT count(*) FROM dayset b WHERE b.year = a.year AND b.tile_col = a.tile_col
                    AND b.tile_row = a.tile_row AND b.split = a.split AND b.dob BETWEEN a.dob + 1 AND a.dob + 3) = 3
                  AND (SELECT count(*) FROM bad b WHERE b.year = a.year AND b.tile_col = a.tile_col AND b.tile_row = a.tile_row AND b.dob BETWEEN a.dob + 1 AND a.dob + 2) = 0) q
            JOIN (SELECT unnest(range(3)) AS step) s ON true
            JOIN channels c ON c.year = q.year AND c.tile_col = q.tile_col AND c.tile_row = q.tile_row AND c.dob = q.dob + s.step
            GROUP BY q.split, q.year, q.tile_col, q.tile_row, q.dob, s.step""",
        "raster", "tiled", "env", "bad", "pairs", "members", "split", "cur", "grown", "dayset", "fixed", "moving", "still", "channels",
        instead=_BASE, env=_ENV, bad=f"SELECT DISTINCT {TD} FROM env WHERE g IS NULL", dayset=DAY_SPLIT, fixed=_FIXED,
        moving=_STATS, still=_STATIC_STATS, channels=_CHANNELS,
    ),
)
def e2_materialise_sequences(spark, d):
    """Sequences of three days as arrays, written and read back: checksums per step, positions and labels."""
    index, environment, statics, gate, _ = materialise_inputs(spark, d)
    path = scratch_path(spark, "sequences")
    sample_source.export_samples(materialise.sequences(index, environment, statics, gate), path)
    steps = spark.read.parquet(path).select("split", "year", *TILE, "start_dob", "positions", F.size(F.coalesce("y", F.array())).cast("bigint").alias("label"), F.explode("x").alias("s"))
    return steps.select(
        "split", "year", *TILE, "start_dob", F.col("s.step").alias("step"), r(_plane(F.col("s.x"), "tmax"), 2).alias("tmax"),
        r(_plane(F.col("s.x"), "previous_burn_mask"), 2).alias("previous_burn_mask"),
        F.element_at("positions", F.col("s.step") + 1).cast("int").alias("position"), "label",
    )
