"""Burn points on the tile lattice: rasterising, tile-day tables and extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions import geo, timeops

TILE = ("tile_col", "tile_row")
TILE_DAY = ("year", "tile_col", "tile_row", "dob")
PIXEL = ("pixel_y", "pixel_x")


def locate(points: DataFrame, grid: int = k.GRID_SIZE, pixel: float = k.PIXEL_SIZE) -> DataFrame:
    """Project burn points and assign tile and pixel."""
    return geo.with_tile(geo.with_projection(points), grid=grid, pixel=pixel)


def only_fire(points: DataFrame, fire_id: str) -> DataFrame:
    """Points of one fire; an unknown fire gives an empty result."""
    return points.where(F.col("id") == F.lit(fire_id))


def rasterise_last(
    points: DataFrame, values: dict[str, object], keys: tuple[str, ...], seq: str = "row_seq"
) -> DataFrame:
    """One row per key with the values of the last point written there.

    ``seq`` is a BIGINT, so the aggregate keeps fixed-width buffers and combines before the shuffle.
    """
    return points.groupBy(*keys).agg(*[F.max_by(expr, F.col(seq)).alias(name) for name, expr in values.items()])


def fold_points(located: DataFrame) -> DataFrame:
    """Points folded to one row per fire, day and pixel; index, metadata, masks all derive from it.

    ``row_seq`` is the first write (with its position), ``last_seq`` the last one (with its flags).
    Columns a caller does not select are not aggregated.
    """
    known = located.where(F.col("id").isNotNull() & F.col("dob").isNotNull())
    return known.groupBy("year", *TILE, "id", "fireday", "dob", *PIXEL).agg(
        F.min("row_seq").alias("row_seq"), F.max("row_seq").alias("last_seq"),
        F.min_by("lon", "row_seq").alias("lon"), F.min_by("lat", "row_seq").alias("lat"),
        F.max_by(F.col("firearea") > 0, "row_seq").alias("firearea"),
        F.max_by(F.col("cumuarea") > 0, "row_seq").alias("cumuarea"),
    )


def burn_layers(located: DataFrame) -> DataFrame:
    """Burn flags and observed coordinates per fire, day and pixel (burned or not)."""
    return rasterise_last(
        located,
        {
            "firearea": F.col("firearea") > 0,
            "cumuarea": F.col("cumuarea") > 0,
            "easting": F.col("easting").cast("float"),
            "northing": F.col("northing").cast("float"),
            "lat": F.col("lat").cast("float"),
            "lon": F.col("lon").cast("float"),
        },
        keys=("year", *TILE, "id", "fireday", *PIXEL),
    )


def tile_fires(located: DataFrame) -> DataFrame:
    """Distinct (fire, fire day) per tile-day with ``first_seq``, the order of first appearance.

    Long form: nothing is collected per tile-day, however many points or fires it holds.
    """
    return (
        located.where(F.col("id").isNotNull() & F.col("dob").isNotNull())
        .groupBy(*TILE_DAY, "id", "fireday")
        .agg(F.min("row_seq").alias("first_seq"))
    )


def pack_tile_fires(fires: DataFrame) -> DataFrame:
    """Array form of ``tile_fires`` for the JSON sink: fires in order of first appearance."""
    entry = F.struct("first_seq", F.col("id").alias("fire_id"), geo.day_key("fireday").alias("day_key"), "fireday")
    packed = F.array_sort(F.collect_list(entry))
    slim = F.transform(packed, lambda e: F.struct(e["fire_id"], e["day_key"], e["fireday"]))
    return fires.groupBy(*TILE_DAY).agg(slim.alias("fires")).withColumn("tile_id", geo.tile_id())


def unpack_tile_fires(packed: DataFrame) -> DataFrame:
    """Back to the long form; the array position takes the place of ``first_seq``."""
    return packed.select(*TILE_DAY, F.posexplode("fires").alias("first_seq", "f")).select(
        *TILE_DAY, F.col("f.fire_id").alias("id"), "f.fireday", F.col("first_seq").cast("bigint")
    )


def overlap_summary(fires: DataFrame) -> DataFrame:
    """Tile-days, tile-days with several fires, and the largest number of fires in one."""
    per_day = fires.groupBy(*TILE_DAY).agg(F.count("*").alias("n"))
    return per_day.agg(
        F.count("*").alias("tile_days"),
        F.count_if(F.col("n") > 1).alias("overlapping"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_overlap"),
    )


def primary_fire(fires: DataFrame) -> DataFrame:
    """The first listed fire of every tile-day."""
    return fires.groupBy(*TILE_DAY).agg(
        F.min_by("id", "first_seq").alias("primary_fire"), F.min_by("fireday", "first_seq").alias("primary_fireday")
    )


def fire_order(fires: DataFrame) -> DataFrame:
    """Explicit fire order per tile-day and day order per fire and tile.

    For output: inside the library ``first_seq`` and ``fireday`` themselves are compared, so no
    mask or label depends on ranking the fires of a tile-day in one place.
    """
    by_seq = Window.partitionBy(*TILE_DAY).orderBy("first_seq")
    by_day = Window.partitionBy("year", *TILE, "id").orderBy("fireday")
    return fires.withColumns({"fire_ord": F.row_number().over(by_seq), "day_ord": F.dense_rank().over(by_day)})


def first_rows(located: DataFrame) -> DataFrame:
    """First point of every (fire, tile, fire day): the source of the day metadata."""
    pick = lambda c: F.min_by(c, "row_seq").alias(c)
    return located.groupBy("year", *TILE, "id", "fireday").agg(pick("dob"), pick("lon"), pick("lat"))


def tile_day_metadata(located: DataFrame, tz_regions: DataFrame) -> DataFrame:
    """Time zone and UTC times of every (fire, tile, fire day)."""
    days = with_time_zone(first_rows(located), tz_regions)
    times = timeops.local_day_to_utc(timeops.dob_to_date(F.col("year"), F.col("dob")), F.col("tz"))
    known = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("dob").isNotNull()
    return days.withColumns({name: F.when(known, expr) for name, expr in times.items()})


def with_time_zone(df: DataFrame, regions: DataFrame, default: str = "UTC") -> DataFrame:
    """Time zone of a point from a table of boxes; of boxes that overlap the first name counts.

    The boxes are listed per whole degree of longitude, so a point meets one row and is never multiplied.
    """
    bound = lambda c, end: F.col(c) if c in regions.columns else F.lit(end)
    box = F.struct("name", "lon_min", "lon_max", bound("lat_min", -90.0).alias("lat_min"), bound("lat_max", 90.0).alias("lat_max"))
    cells = regions.select(
        box.alias("z"), F.explode(F.sequence(F.floor("lon_min"), F.ceil("lon_max") - 1)).alias("_cell")
    ).groupBy("_cell").agg(F.collect_list("z").alias("_boxes"))
    north = F.col("lat") if "lat" in df.columns else F.lit(0.0)
    inside = lambda z: (
        (F.col("lon") >= z["lon_min"]) & (F.col("lon") < z["lon_max"]) & (north >= z["lat_min"]) & (north < z["lat_max"])
    )
    # Time zones are a fixed list: some hundred boxes in at most 360 rows.
    joined = df.withColumn("_cell", F.floor("lon")).join(F.broadcast(cells), "_cell", "left")
    name = F.array_min(F.transform(F.filter("_boxes", inside), lambda z: z["name"]))
    return joined.withColumn("tz", F.coalesce(name, F.lit(default))).drop("_cell", "_boxes")


def dense_scaffold(
    tile_days: DataFrame, sparse: DataFrame, values: dict[str, object],
    keys: tuple[str, ...] = TILE_DAY, grid: int = k.GRID_SIZE,
) -> DataFrame:
    """All ``grid**2`` cells of every tile-day, sparse values where known, defaults elsewhere.

    Each tile-day multiplies into grid**2 rows, so filter tile-days first.
    """
    cells = tile_days.select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("pixel_y")
    ).withColumn("pixel_x", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    filled = cells.join(sparse.select(*keys, *PIXEL, *values), [*keys, *PIXEL], "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c, default in values.items()})


def extents(points: DataFrame, key: str | list[str]) -> DataFrame:
    """Bounding box, centroid, point count and burn-day range per key."""
    keys = [key] if isinstance(key, str) else key
    return points.groupBy(*keys).agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"),
        F.min("dob").alias("first_dob"), F.max("dob").alias("last_dob"),
        F.count("*").alias("points"),
    )


def active_days(located: DataFrame, *keys: str) -> DataFrame:
    """Distinct combinations, such as the days or tiles of a fire."""
    return located.select(*keys).distinct()


def day_key_for_dob(located: DataFrame) -> DataFrame:
    """First fire-day key of a fire in a tile that carries a given day of burn."""
    return (
        first_rows(located)
        .groupBy("year", *TILE, "id", "dob")
        .agg(F.min("fireday").alias("fireday"))
        .withColumn("day_key", geo.day_key("fireday"))
    )
