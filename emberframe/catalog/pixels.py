"""Queries on raster pixels: normalisation, quality, stencils, channels and sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.catalog import fixtures
from emberframe.catalog.environment import mosaic_cells
from emberframe.catalog.registry import r, register, rounded
from emberframe.catalog.sql import R, query
from emberframe.functions import geo, values
from emberframe.operators import channels, metrics, pairing, quality, sampling, stats, stencil
from emberframe.operators.tiles import PIXEL
from emberframe.session import scratch_path
from emberframe.sources import samples, stats_json, tables

DAY = ("vec_id",)
SIDE = 8


def raster(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.load(spark, d, "raster")


def burned(spark: SparkSession, d: str, above: float = 0.0) -> DataFrame:
    """Sparse mask of a patch."""
    return raster(spark, d).where(F.col("v") > above).select(*DAY, *PIXEL)


@register("c13_cyclical", query(f"SELECT vec_id, pixel_y, pixel_x, {R('sin(radians(v * 360))')} AS s, {R('cos(radians(v * 360))')} AS c FROM raster", "raster"))
def c13(spark, d):
    s, c = values.cyclical(F.col("v") * 360)
    return raster(spark, d).select(*DAY, *PIXEL, r(s).alias("s"), r(c).alias("c"))


GAPPY = "CASE WHEN v < -3e-1 THEN NULL ELSE v END"


def gappy(spark, d) -> DataFrame:
    return raster(spark, d).withColumn("v", F.when(F.col("v") >= -0.3, F.col("v")))


@register(
    "c15_zscore",
    query(
        f"""SELECT vec_id, pixel_y, pixel_x, {R('coalesce((g - m) / s, 0e0)')} AS dynamic, {R('(g - m) / s')} AS static
            FROM (SELECT *, {GAPPY} AS g FROM raster) q, (SELECT avg(g) AS m, stddev_pop(g) + 1e-8 AS s FROM (SELECT {GAPPY} AS g FROM raster) u) t""",
        "raster",
    ),
)
def c15(spark, d):
    px = gappy(spark, d).withColumns({"dynamic": F.col("v"), "static": F.col("v")})
    table = stats.feature_stats(px, ["dynamic", "static"])
    return rounded(stats.normalise(px, table, ["dynamic"], ["static"]).select(*DAY, *PIXEL, "dynamic", "static"), "dynamic", "static")


@register(
    "c23_finite_or_zero",
    query(f"SELECT vec_id, {R('sum(CASE WHEN v > 2e-1 OR v < -2e-1 THEN 0e0 ELSE v END)')} AS total FROM raster GROUP BY vec_id", "raster"),
)
def c23(spark, d):
    odd = F.when(F.col("v") > 0.2, float("inf")).when(F.col("v") < -0.2, float("nan")).otherwise(F.col("v"))
    return raster(spark, d).groupBy("vec_id").agg(r(F.sum(values.finite_or_zero(odd))).alias("total"))


@register(
    "c27_narrow_types",
    query(f"SELECT vec_id, pixel_y, pixel_x, {R('cast(cast(v AS float) AS double)')} AS value, cast(label AS smallint) AS label, cast(vec_id % 366 AS smallint) AS position FROM raster", "raster"),
)
def c27(spark, d):
    kinds = values.narrow_types()
    out = raster(spark, d).select(
        *DAY, *PIXEL, F.col("v").cast(kinds["value"]).alias("value"), F.col("label").cast(kinds["label"]).alias("label"),
        (F.col("vec_id") % 366).cast(kinds["position"]).alias("position"),
    )
    return out.withColumn("value", r(F.col("value").cast("double")))


def channel_pixels(spark, d) -> DataFrame:
    """25 channels per pixel: multiples of the patch value."""
    return raster(spark, d).select(*DAY, *PIXEL, *[(F.col("v") * (i + 1)).alias(c) for i, c in enumerate(k.CHANNELS)])


_SETS = {"all_channels": sum(range(1, 26)), "environment_only": sum(range(1, 24)), "no_satellite": sum(range(1, 26)) - sum(range(9, 16))}


@register(
    "c32_feature_sets",
    query(" UNION ALL ".join(f"SELECT vec_id, '{n}' AS feature_set, {R(f'sum(v * {w})')} AS total FROM raster GROUP BY vec_id" for n, w in _SETS.items()), "raster"),
)
def c32(spark, d):
    px = channel_pixels(spark, d)
    total = lambda n: F.sum(sum((F.col(c) for c in values.feature_set(n, px.columns)), F.lit(0.0)))
    sets = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.col(f"t_{n}").alias("total")) for n in _SETS])
    wide = px.groupBy(*DAY).agg(*[total(n).alias(f"t_{n}") for n in _SETS])
    return wide.select(*DAY, F.explode(sets).alias("s")).select(*DAY, "s.feature_set", r("s.total").alias("total"))


def environment_pixels(spark, d):
    """Dynamics per day and pixel, statics per tile and pixel, burned pixels per day."""
    px = raster(spark, d)
    dynamics = px.select(
        *DAY, "label", *PIXEL, *[F.when(F.col("v") > -0.3, F.col("v") * (i + 1)).alias(c) for i, c in enumerate(k.DYNAMIC_FEATURES)]
    )
    first = px.groupBy("label", *PIXEL).agg(F.min_by("v", "vec_id").alias("v"))
    statics = first.select("label", *PIXEL, *[(F.col("v") * 10 * (i + 1)).alias(c) for i, c in enumerate(k.STATIC_FEATURES)])
    masks = px.where("v > 0.1").select(*DAY, "label", *PIXEL, (F.col("label") / 100.0).alias("fireday_grid"))
    return dynamics, statics, masks


@register(
    "c34_assemble_channels",
    query(
        f"""SELECT vec_id, {R('sum(coalesce((g - gm) / gs, 0e0))')} AS tmax, {R('sum(coalesce(g * 7, 0e0))')} AS evi,
                   {R('sum(coalesce(g * 9, 0e0) * 1e-4)')} AS s2_b02, {R('sum(coalesce(g * 15, 0e0) * 1e-4)')} AS s2_scl,
                   {R('sum((10 * f - fm) / fs)')} AS dem, {R('sum(sin(radians(30 * f)))')} AS aspect_sin, {R('sum(cos(radians(30 * f)))')} AS aspect_cos,
                   {R('sum(CASE WHEN v > 1e-1 THEN 1e0 ELSE 0e0 END)')} AS previous_burn_mask,
                   {R('sum(CASE WHEN v > 1e-1 THEN label / 1e2 ELSE 0e0 END)')} AS fireday_grid
            FROM (SELECT *, CASE WHEN v > -3e-1 THEN v END AS g FROM raster) a JOIN first USING (label, pixel_y, pixel_x),
                 (SELECT avg(CASE WHEN v > -3e-1 THEN v END) AS gm, stddev_pop(CASE WHEN v > -3e-1 THEN v END) + 1e-8 AS gs FROM raster) s1,
                 (SELECT avg(10 * f) AS fm, stddev_pop(10 * f) + 1e-8 AS fs FROM first) s2 GROUP BY vec_id""",
        "raster", first="SELECT label, pixel_y, pixel_x, arg_min(v, vec_id) AS f FROM raster GROUP BY ALL",
    ),
)
def c34(spark, d):
    dynamics, statics, masks = environment_pixels(spark, d)
    table = stats.feature_stats(dynamics, list(k.WEATHER_FEATURES)).unionByName(
        stats.feature_stats(statics, list(k.STATIC_FEATURES), k.TERRAIN_NODATA)
    )
    px = channels.assemble_channels(dynamics, statics, masks, table, (*DAY, "label"), ("label",))
    shown = ("tmax", "evi", "s2_b02", "s2_scl", "dem", "aspect_sin", "aspect_cos", "previous_burn_mask", "fireday_grid")
    return px.groupBy(*DAY).agg(*[r(F.sum(c)).alias(c) for c in shown])


CHECKED = ("a", "b")


def checked_pixels(spark, d) -> DataFrame:
    """Two features with holes: missing, not a number, infinite, and one absent from whole days."""
    v = F.col("v")
    return raster(spark, d).select(
        *DAY, *PIXEL, F.when(v < 0.33, v).otherwise(F.lit(float("nan"))).alias("a"),
        F.when((F.col("label") != 3) & (v > -0.33), v).when(F.col("label") != 3, float("inf")).alias("b"),
    )


BAD_SQL = "v >= 33e-2 OR label = 3 OR v <= -33e-2"


@register("a12_quality_mask", query(f"SELECT vec_id, pixel_y, pixel_x FROM raster WHERE {BAD_SQL}", "raster"))
def a12(spark, d):
    return quality.quality_mask(checked_pixels(spark, d), list(CHECKED), DAY)


@register(
    "a12_quality_summary",
    query(f"SELECT count(*) FILTER (WHERE n = 0) AS clean_days, count(*) FILTER (WHERE n > 0) AS problem_days FROM (SELECT count(*) FILTER (WHERE {BAD_SQL}) AS n FROM raster GROUP BY vec_id) q", "raster"),
)
def a12_summary(spark, d):
    return quality.quality_summary(quality.tile_day_quality(checked_pixels(spark, d), list(CHECKED), DAY))


@register("f4_quality_gate", query(f"SELECT vec_id FROM raster GROUP BY vec_id HAVING count(*) FILTER (WHERE {BAD_SQL}) = 0", "raster"))
def f4(spark, d):
    bad = quality.quality_mask(checked_pixels(spark, d), list(CHECKED), DAY)
    return pairing.pass_gate(raster(spark, d).select(*DAY).distinct(), bad, DAY)


@register(
    "f7_interesting_samples",
    query("SELECT vec_id, class_1, class_2 FROM (SELECT vec_id, count(*) FILTER (WHERE v > 0 AND v <= 1e-1) AS class_1, count(*) FILTER (WHERE v > 1e-1) AS class_2 FROM raster GROUP BY vec_id) q WHERE class_1 >= 12 AND class_2 >= 12", "raster"),
)
def f7(spark, d):
    label = F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0)
    return sampling.interesting(raster(spark, d).withColumn("label", label), DAY, min_pixels=12, classes=3)


@register(
    "a6_feature_stats",
    query(
        f"""SELECT feature, {R('mean')} AS mean, {R('std', 7)} AS std, {R('mn')} AS min, {R('mx')} AS max, n AS count FROM (
              SELECT 'tmax' AS feature, avg(v) AS mean, stddev_pop(v) + 1e-8 AS std, min(v) AS mn, max(v) AS mx, count(v) AS n FROM used
              UNION ALL SELECT 'rh', avg(2 * v), stddev_pop(2 * v) + 1e-8, min(2 * v), max(2 * v), count(v) FROM used
              UNION ALL SELECT 'dem', avg(s), stddev_pop(s) + 1e-8, min(s), max(s), count(s) FROM statics WHERE label IN (SELECT label FROM used)) q""",
        "raster",
        used="SELECT * FROM raster WHERE label < 7 AND vec_id IN (SELECT vec_id FROM raster GROUP BY vec_id HAVING max(v) < 35e-2)",
        statics="SELECT label, pixel_y, pixel_x, CASE WHEN arg_min(v, vec_id) >= -3e-1 THEN arg_min(v, vec_id) END AS s FROM raster GROUP BY ALL",
    ),
)
def a6(spark, d):
    return rounded(training_table(spark, d), "mean", "min", "max").withColumn("std", r("std", 7))


def training_table(spark, d) -> DataFrame:
    px = raster(spark, d)
    dynamics = px.select(*DAY, "label", *PIXEL, F.col("v").alias("tmax"), (F.col("v") * 2).alias("rh"), F.col("v").alias("ndvi"))
    first = px.groupBy("label", *PIXEL).agg(F.min_by("v", "vec_id").alias("dem"))
    statics = first.withColumn("dem", F.when(F.col("dem") >= -0.3, F.col("dem")).otherwise(k.TERRAIN_NODATA))
    clean = px.groupBy(*DAY, "label").agg(F.max("v").alias("m")).where("m < 0.35")
    return stats.training_stats(
        dynamics, statics, px.where("label < 7").select(*DAY, "label"), clean,
        [*DAY, "label"], ["label"], ["tmax", "rh", "ndvi"], ["dem"],
    )


@register(
    "s5_feature_stats_json",
    query(f"SELECT 'v' AS feature, {R('avg(v)')} AS mean, {R('stddev_pop(v) + 1e-8', 7)} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max, count(v) AS count FROM raster", "raster"),
)
def s5(spark, d):
    path = scratch_path(spark, "feature-stats")
    stats_json.write_feature_stats(stats.feature_stats(raster(spark, d), ["v"]), path)
    return rounded(stats_json.read_feature_stats(spark, path), "mean", "min", "max").withColumn("std", r("std", 7))


@register(
    "a24_average_resample",
    query(f"SELECT vec_id, cast(floor(pixel_y / 4e0) AS int) AS pixel_y, cast(floor(pixel_x / 4e0) AS int) AS pixel_x, {R('avg(v)')} AS v FROM raster GROUP BY ALL", "raster"),
)
def a24(spark, d):
    return rounded(stencil.average_resample(raster(spark, d), "v", DAY, 4), "v")


@register(
    "a25_max_pool",
    query(f"SELECT vec_id, cast(floor(pixel_y / 2e0) AS int) AS pixel_y, cast(floor(pixel_x / 2e0) AS int) AS pixel_x, {R('max(v)')} AS v FROM raster GROUP BY ALL", "raster"),
)
def a25(spark, d):
    return rounded(stencil.max_pool(raster(spark, d), "v", DAY, 2), "v")


OFFSETS = "(SELECT a.o AS dy, b.o AS dx FROM (VALUES (-1), (0), (1)) a(o), (VALUES (-1), (0), (1)) b(o)) o"
AROUND = f"""SELECT c.vec_id, c.pixel_y, c.pixel_x, c.v AS centre, dy, dx, n.v AS v FROM raster c CROSS JOIN {OFFSETS}
    LEFT JOIN raster n ON n.vec_id = c.vec_id AND n.pixel_y = c.pixel_y + dy AND n.pixel_x = c.pixel_x + dx"""
# ``v`` shifted by every offset: the patch in feature order.
R1_SQL = f"""SELECT vec_id, pixel_y, pixel_x, count(*) AS features,
    {R('sum(coalesce(v, 0e0) * ((dy + 1) * 3 + dx + 2))')} AS weighted FROM around GROUP BY ALL"""


@register("r1_extract_patches", query(R1_SQL, "raster", around=AROUND))
def r1(spark, d):
    out = stencil.extract_patches(raster(spark, d), ["v"], 3, DAY)
    weighted = F.aggregate(
        F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(*DAY, *PIXEL, F.size("features").cast("bigint").alias("features"), r(weighted).alias("weighted"))


@register(
    "j17_stencil_neighbours",
    query(f"SELECT vec_id, pixel_y, pixel_x, count(v) AS n, {R('sum(v)')} AS total FROM around GROUP BY ALL", "raster", around=AROUND),
)
def j17(spark, d):
    pushed = stencil.push_to_neighbours(raster(spark, d).select(*DAY, *PIXEL, "v"), stencil.SQUARE, SIDE)
    return pushed.groupBy(*DAY, *PIXEL).agg(F.count("*").alias("n"), r(F.sum("v")).alias("total"))


GREY_SQL = f"""SELECT c.vec_id, c.pixel_y, c.pixel_x, min(n.v) AS v FROM raster c CROSS JOIN {OFFSETS}
    JOIN dilated n ON n.vec_id = c.vec_id AND n.pixel_y = c.pixel_y + dy AND n.pixel_x = c.pixel_x + dx GROUP BY ALL"""
DILATED_SQL = "SELECT vec_id, pixel_y, pixel_x, max(v) AS v FROM around GROUP BY ALL"


@register("r2_closing_grey", query(f"SELECT vec_id, pixel_y, pixel_x, {R('v')} AS v FROM closed", "raster", around=AROUND, dilated=DILATED_SQL, closed=GREY_SQL))
def r2_grey(spark, d):
    return rounded(stencil.close_dense(raster(spark, d), "v", DAY).select(*DAY, *PIXEL, "v"), "v")


@register("r2_closing_binary", query("SELECT vec_id, pixel_y, pixel_x FROM closed WHERE v > 5e-2", "raster", around=AROUND, dilated=DILATED_SQL, closed=GREY_SQL))
def r2_binary(spark, d):
    return stencil.close_mask(burned(spark, d, 0.05), DAY, SIDE)


R3_SQL = """SELECT cast(count(*) FILTER (WHERE t AND p) AS bigint) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn
    FROM (SELECT max(v) > 5e-2 AS t, max(v) > 1e-1 AS p FROM closed GROUP BY vec_id, floor(pixel_y / 2e0), floor(pixel_x / 2e0)) q"""


@register("r3_coarse_metrics", query(R3_SQL, "raster", around=AROUND, dilated=DILATED_SQL, closed=GREY_SQL))
def r3(spark, d):
    return metrics.coarse_metrics(burned(spark, d, 0.05), burned(spark, d, 0.1), DAY, SIDE)


# Labels independent of the scores; closing, pooling and counting as for the scores.
_MARKED = "SELECT vec_id, pixel_y, pixel_x, CASE WHEN sin(v * 37e0) > 9e-1 THEN 1e0 ELSE 0e0 END AS v FROM raster"
_OF_MARKS = lambda text: text.replace("FROM raster c", "FROM marked c").replace("JOIN raster n", "JOIN marked n")
R3_FULL_SQL = f"""SELECT tp, fp, fn, tn, {R('cast(tp AS double) / (tp + fp + fn)')} AS iou, {R('2e0 * tp / (2 * tp + fp + fn)')} AS dice,
    {R('cast(tp AS double) / (tp + fp)')} AS precision, {R('cast(tp AS double) / (tp + fn)')} AS recall,
    {R('cast(tp + tn AS double) / (tp + fp + fn + tn)')} AS accuracy,
    (SELECT {R('sum(pos * (p + coalesce(before, 1e0)) / 2) / sum(pos)')} FROM steps) AS auc_pr, (SELECT {R('sum(pos * p) / sum(pos)')} FROM steps) AS average_precision
    FROM (SELECT count(*) FILTER (WHERE score > 1e-1 AND label = 1) AS tp, count(*) FILTER (WHERE score > 1e-1 AND label = 0) AS fp,
          count(*) FILTER (WHERE score <= 1e-1 AND label = 1) AS fn, count(*) FILTER (WHERE score <= 1e-1 AND label = 0) AS tn FROM pooled) q"""
_BLOCKS = "SELECT vec_id, floor(pixel_y / 2e0) AS y, floor(pixel_x / 2e0) AS x, max(v) AS v FROM {0} GROUP BY ALL"


@register(
    "r3_coarse_evaluation",
    query(
        R3_FULL_SQL, "raster", around=AROUND, dilated=DILATED_SQL, closed=GREY_SQL, marked=_MARKED, around2=_OF_MARKS(AROUND),
        dilated2="SELECT vec_id, pixel_y, pixel_x, max(v) AS v FROM around2 GROUP BY ALL",
        closed2=_OF_MARKS(GREY_SQL).replace("JOIN dilated n", "JOIN dilated2 n"),
        pooled=f"SELECT a.v AS score, b.v AS label FROM ({_BLOCKS.format('closed')}) a JOIN ({_BLOCKS.format('closed2')}) b USING (vec_id, y, x)",
        steps="""SELECT *, lag(p) OVER (ORDER BY score DESC) AS before FROM (SELECT *, cast(tp AS double) / (tp + fp) AS p FROM (
            SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM (
              SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM pooled GROUP BY score) a) b) c""",
    ),
)
def r3_full(spark, d):
    cells = raster(spark, d).select(*DAY, *PIXEL, F.col("v").alias("score"), (F.sin(F.col("v") * 37) > 0.9).cast("int").alias("label"))
    out = metrics.coarse_evaluation(cells, DAY, SIDE, threshold=0.1)
    rates = ("iou", "dice", "precision", "recall", "accuracy", "auc_pr", "average_precision")
    return rounded(out.select("tp", "fp", "fn", "tn", *rates), *rates)


CROSS_SQL = """SELECT a.vec_id, a.pixel_y, a.pixel_x FROM raster a JOIN raster n ON n.vec_id = a.vec_id
    AND abs(n.pixel_y - a.pixel_y) + abs(n.pixel_x - a.pixel_x) = 1 WHERE a.v <= 0
    GROUP BY ALL HAVING bool_and(n.v > 0)"""


@register("r4_fill_holes", query("SELECT vec_id, pixel_y, pixel_x FROM raster WHERE v > 0 UNION ALL SELECT * FROM holes", "raster", holes=CROSS_SQL))
def r4(spark, d):
    return stencil.fill_holes(burned(spark, d), DAY, 1, SIDE)


@register(
    "r4_fill_larger_holes",
    query(
        """SELECT vec_id, pixel_y, pixel_x FROM raster WHERE v > 0 UNION ALL
           SELECT r.vec_id, r.y, r.x FROM (SELECT vec_id, y, x FROM spread GROUP BY ALL HAVING count(*) <= 3) r""",
        "raster",
        spread="""SELECT vec_id, pixel_y AS y, pixel_x AS x, pixel_y AS ty, pixel_x AS tx FROM raster WHERE v <= 0
                  UNION SELECT s.vec_id, s.y, s.x, n.pixel_y, n.pixel_x FROM spread s JOIN raster n ON n.vec_id = s.vec_id
                  AND abs(n.pixel_y - s.ty) + abs(n.pixel_x - s.tx) = 1 AND n.v <= 0""",
    ),
)
def r4_larger(spark, d):
    return stencil.fill_holes(burned(spark, d), DAY, 3, SIDE)


# The nine heights of each window: n<row><column> for offsets m (-1), z (0), p (1).
_WINDOW = ", ".join(
    f"max(CASE WHEN dy = {dy} AND dx = {dx} THEN v END) * 100 AS n{'mzp'[dy + 1]}{'mzp'[dx + 1]}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
)
WINDOW = f"SELECT vec_id, pixel_y, pixel_x, centre * 100 AS c, {_WINDOW} FROM around GROUP BY ALL"
# In the first and last row, columns outside repeat the edge and rows outside go on in a line; elsewhere columns go on in a line.
SIDED = """SELECT vec_id, pixel_y, pixel_x, c,
    CASE WHEN pixel_y IN (0, 7) THEN CASE WHEN pixel_x = 0 THEN nmz ELSE nmm END WHEN pixel_x = 0 THEN 2 * nmz - nmp ELSE nmm END AS mm, nmz AS mz,
    CASE WHEN pixel_y IN (0, 7) THEN CASE WHEN pixel_x = 7 THEN nmz ELSE nmp END WHEN pixel_x = 7 THEN 2 * nmz - nmm ELSE nmp END AS mp,
    CASE WHEN pixel_y IN (0, 7) THEN CASE WHEN pixel_x = 0 THEN nzz ELSE nzm END WHEN pixel_x = 0 THEN 2 * nzz - nzp ELSE nzm END AS zm, nzz AS zz,
    CASE WHEN pixel_y IN (0, 7) THEN CASE WHEN pixel_x = 7 THEN nzz ELSE nzp END WHEN pixel_x = 7 THEN 2 * nzz - nzm ELSE nzp END AS zp,
    CASE WHEN pixel_y IN (0, 7) THEN CASE WHEN pixel_x = 0 THEN npz ELSE npm END WHEN pixel_x = 0 THEN 2 * npz - npp ELSE npm END AS pm, npz AS pz,
    CASE WHEN pixel_y IN (0, 7) THEN CASE WHEN pixel_x = 7 THEN npz ELSE npp END WHEN pixel_x = 7 THEN 2 * npz - npm ELSE npp END AS pp
    FROM windows"""
FILLED = """SELECT vec_id, pixel_y, pixel_x, coalesce(zm, c) AS zm, coalesce(zp, c) AS zp,
    coalesce(CASE WHEN pixel_y = 0 THEN 2 * zm - pm ELSE mm END, c) AS mm, coalesce(CASE WHEN pixel_y = 0 THEN 2 * zz - pz ELSE mz END, c) AS mz,
    coalesce(CASE WHEN pixel_y = 0 THEN 2 * zp - pp ELSE mp END, c) AS mp, coalesce(CASE WHEN pixel_y = 7 THEN 2 * zm - mm ELSE pm END, c) AS pm,
    coalesce(CASE WHEN pixel_y = 7 THEN 2 * zz - mz ELSE pz END, c) AS pz, coalesce(CASE WHEN pixel_y = 7 THEN 2 * zp - mp ELSE pp END, c) AS pp FROM sided"""
HORN = "SELECT vec_id, pixel_y, pixel_x, (mp + 2 * zp + pp) - (mm + 2 * zm + pm) AS dx, (pm + 2 * pz + pp) - (mm + 2 * mz + mp) AS dy FROM filled"
_HORN = {"around": AROUND, "windows": WINDOW, "sided": SIDED, "filled": FILLED, "horn": HORN}


def _terrain(spark, d) -> DataFrame:
    heights = raster(spark, d).withColumn("dem", F.col("v") * 100)
    return stencil.slope_aspect(heights, "dem", DAY, 90.0, SIDE)


@register("r5_slope", query(f"SELECT vec_id, pixel_y, pixel_x, {R('degrees(atan(sqrt(dx * dx + dy * dy) / 72e1))')} AS slope FROM horn", "raster", **_HORN))
def r5(spark, d):
    return rounded(_terrain(spark, d).select(*DAY, *PIXEL, "slope"), "slope")


@register(
    "r6_aspect",
    query(
        f"SELECT vec_id, pixel_y, pixel_x, {R('CASE WHEN dx = 0 AND dy = 0 THEN 0e0 WHEN a > 90 THEN 450 - a ELSE 90 - a END', 4)} AS aspect FROM (SELECT *, degrees(atan2(dy, -dx)) AS a FROM horn) q",
        "raster", **_HORN,
    ),
)
def r6(spark, d):
    return rounded(_terrain(spark, d).select(*DAY, *PIXEL, "aspect"), "aspect", digits=4)


@register(
    "r7_crop_to_lattice",
    query(
        f"""SELECT tc AS tile_col, tr AS tile_row, cast(floor((x - tc * 2304e1) / 288e1) AS int) AS pixel_x,
                   cast(floor(((tr + 1) * 2304e1 - y) / 288e1) AS int) AS pixel_y, {R('avg(v)')} AS dem
            FROM (SELECT *, cast(floor(x / 2304e1) AS int) AS tc, cast(ceil(y / 2304e1) - 1 AS int) AS tr FROM
                  (SELECT 43e5 + ix * 2e3 AS x, 25e5 + iy * 2e3 AS y, v FROM mosaic) a) b GROUP BY ALL""",
        "raster", mosaic="SELECT (vec_id % 20) * 8 + pixel_x AS ix, cast(floor(vec_id / 20e0) AS bigint) * 8 + pixel_y AS iy, v FROM raster",
    ),
)
def r7(spark, d):
    span = float(k.GRID_SIZE * k.PIXEL_SIZE)
    cells = mosaic_cells(spark, d).withColumns(
        {"tile_col": F.floor(F.col("x") / span).cast("int"), "tile_row": (F.ceil(F.col("y") / span) - 1).cast("int")}
    )
    bounds = geo.tile_bounds(F.col("tile_col"), F.col("tile_row"))
    snapped = stencil.crop_to_tile(cells, bounds, 2880.0)
    return rounded(
        stencil.average_resample(snapped.withColumnRenamed("v", "dem"), "dem", ("tile_col", "tile_row"), 1), "dem"
    )


def packed_samples(spark, d, channel: F.Column) -> DataFrame:
    """One single-channel sample per patch: values, mask label, split by label."""
    px = raster(spark, d).select(
        *DAY, "label", *PIXEL, channel.alias("c0"), (F.col("v") > 0.1).cast("int").alias("y"),
    )
    split = F.when(F.col("label") < 7, "train").when(F.col("label") == 7, "val").otherwise("test")
    return channels.pack(px, (*DAY, "label"), ("c0",), label="y").withColumn("split", split)


@register(
    "s6_export_samples",
    query(
        f"""SELECT vec_id, CASE WHEN label < 7 THEN 'train' WHEN label = 7 THEN 'val' ELSE 'test' END AS split, count(*) AS n,
                   {R('sum(cast(cast(v AS float) AS double) * (pixel_y * 8 + pixel_x + 1))', 4)} AS checksum, count(*) FILTER (WHERE v > 1e-1) AS fire FROM raster GROUP BY vec_id, label""",
        "raster",
    ),
)
def s6(spark, d):
    path = scratch_path(spark, "samples")
    samples.export_samples(packed_samples(spark, d, F.col("v")), path)
    back = spark.read.parquet(path)
    checksum = F.aggregate(F.transform("x", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    fire = F.aggregate("y", F.lit(0).cast("bigint"), lambda a, y: a + y)
    return back.select(*DAY, "split", F.size("x").cast("bigint").alias("n"), r(checksum, 4).alias("checksum"), fire.alias("fire"))


@register(
    "s7_ingest_sample_archives",
    query("SELECT cast(vec_id AS varchar) AS sample, pixel_y, pixel_x, cast(floor(v * 1000) AS int) AS c0, CASE WHEN v > 1e-1 THEN 1 ELSE 0 END AS label FROM raster", "raster"),
)
def s7(spark, d):
    """Archives are written from the patches inside tasks and decoded again (whole numbers survive float16)."""
    packed = packed_samples(spark, d, F.floor(F.col("v") * 1000)).select(
        F.col("vec_id").cast("string").alias("sample"), F.lit(SIDE).alias("height"), "x", "y"
    )
    rows = samples.decode_archives(samples.encode_archives(packed, 1), 1)
    return rows.select("sample", *PIXEL, F.col("c0").cast("int").alias("c0"), F.col("label").cast("int").alias("label"))


@register(
    "s10_feature_manifest",
    query(
        f"""SELECT channel_name, dy AS row_offset, dx AS col_offset, cast(ch * 9 + (dy + 1) * 3 + dx + 1 AS int) AS feature_index,
                   count(*) FILTER (WHERE v <> 0) AS filled, {R('sum(coalesce(v, 0e0) * (ch + 1))')} AS total
            FROM around, (VALUES (0, 'tmax'), (1, 'rh')) c(ch, channel_name) GROUP BY ALL""",
        "raster", around=AROUND,
    ),
)
def s10(spark, d):
    """The manifest names the features of real patches, summed over the whole table."""
    px = raster(spark, d).select(*DAY, *PIXEL, F.col("v").alias("tmax"), (F.col("v") * 2).alias("rh"))
    patches = stencil.extract_patches(px, ["tmax", "rh"], 3, DAY)
    long = patches.select(F.posexplode("features").alias("feature_index", "value"))
    sums = long.groupBy("feature_index").agg(F.count_if(F.col("value") != 0).alias("filled"), r(F.sum("value")).alias("total"))
    return tables.feature_manifest(spark, ["tmax", "rh"], 3).join(sums, "feature_index").drop("channel_index")
