"""Input tables of the model, derived from the given tables.

Every text runs unchanged on both engines (``{name}`` is the table); where the dialects differ
there are two texts.  All of them read their whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Row order for last-write-wins is (l_orderkey, l_linenumber, l_quantity, l_partkey) packed into
# one BIGINT, so that max_by/min_by keep fixed-width buffers and stay hash aggregates.
BURN_POINTS = """
SELECT concat(cast(year(l_shipdate) AS string), '_', cast(l_suppkey AS string)) AS id,
       cast(year(l_shipdate) AS int) AS year,
       cast(150 + (l_partkey + l_orderkey) % 40 AS int) AS dob,
       cast(1 + (l_partkey + l_orderkey) % 40 AS int) AS fireday,
       -124e0 + ((l_suppkey * 997) % 4000) / 1e3 + (l_orderkey % 40) * 15e-4 AS lon,
       56e0 + ((l_suppkey * 1009) % 1500) / 1e3 + (l_partkey % 40) * 8e-4 AS lat,
       CASE WHEN l_quantity > 20 THEN l_quantity ELSE 0e0 END AS firearea,
       CASE WHEN cast(l_quantity AS bigint) % 9 = 4 THEN 0e0 ELSE l_quantity END AS cumuarea,
       ((l_orderkey * 8 + l_linenumber) * 64 + cast(l_quantity AS bigint)) * 1048576 + l_partkey AS row_seq
FROM {lineitem}
"""

WEATHER_HOURLY = """
SELECT valid_time, latitude, longitude,
       280e0 + hi / 4e1 AS t2m, 275e0 + lo / 4e1 AS d2m,
       (hi - 250e0) / 5e1 AS u10, (lo - 50e0) / 5e1 AS v10,
       cast(sum(n) OVER (PARTITION BY latitude, longitude, cast(valid_time AS date)
                         ORDER BY valid_time) AS double) * 1e-5 AS tp
FROM (SELECT date_trunc('hour', ts) AS valid_time,
             57e0 + (user_id % 2) * 1e-1 AS latitude,
             -122e0 + (floor(user_id / 2e0) % 2) * 1e-1 AS longitude,
             max(value) AS hi, min(value) AS lo, count(*) AS n
      FROM {events} GROUP BY 1, 2, 3) h
"""

# Two overlapping sources per hour; hours with an error event have lost their temperature.
WEATHER_SOURCES = """
SELECT date_trunc('hour', ts) AS valid_time, cast(event_id % 2 AS int) AS source,
       57e0 + (user_id % 2) * 1e-1 AS latitude,
       -122e0 + (floor(user_id / 2e0) % 2) * 1e-1 AS longitude,
       CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1
            THEN NULL ELSE 280e0 + max(value) / 4e1 END AS t2m,
       min(value) AS d2m
FROM {events} GROUP BY 1, 2, 3, 4
"""

# Eight cells of one degree anchored at (-124, 58); composites last four days.
VEG_COMPOSITE = """
SELECT time_start, cell, -124e0 + (cell % 4) + 5e-1 AS lon, 58e0 - floor(cell / 4e0) - 5e-1 AS lat, ndvi, evi
FROM (SELECT cast(date_trunc('day', ts) AS date) - cast((day(ts) - 1) % 4 AS int) AS time_start,
             cast(user_id % 8 AS int) AS cell, max(value) * 2e1 AS ndvi, min(value) * 2e1 AS evi
      FROM {events} GROUP BY 1, 2) v
"""

SCENE = """
SELECT o_orderkey AS scene_id, cast(o_custkey % 20 AS int) AS tile_no, cast(o_orderdate AS date) AS acq_date,
       cast(floor(o_totalprice) % 101 AS double) AS cloud_cover
FROM {orders}
"""

# Footprint boxes for the catalogue search.
FOOTPRINT = """
SELECT o_orderkey AS scene_id, cast(o_orderdate AS date) AS acq_date,
       -124e0 + (o_custkey % 40) / 1e1 - 5e-2 AS min_lon, -124e0 + (o_custkey % 40) / 1e1 + 5e-2 AS max_lon,
       56e0 + (o_orderkey % 15) / 1e1 - 5e-2 AS min_lat, 56e0 + (o_orderkey % 15) / 1e1 + 5e-2 AS max_lat
FROM {orders}
"""

_SCENE_PIXEL = """
SELECT o_orderkey AS scene_id, cast(b AS int) AS band, cast(p AS int) AS pixel,
       cast(CASE WHEN (o_orderkey + p) % 97 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 0
            ELSE (o_orderkey * 31 + p * 17 + b * 7) % 1000 END AS int) AS value
FROM """
SCENE_PIXEL = {
    "spark": _SCENE_PIXEL + "{orders} LATERAL VIEW explode(sequence(0, 15)) t1 AS p"
    " LATERAL VIEW explode(sequence(0, 1)) t2 AS b",
    "duckdb": _SCENE_PIXEL + "{orders} CROSS JOIN (SELECT range AS p FROM range(16)) t1"
    " CROSS JOIN (SELECT range AS b FROM range(2)) t2",
}

# Each 64-vector is one single-channel 8x8 tile.
RASTER = {
    "spark": """
SELECT vec_id, label, cast(floor(i / 8e0) AS int) AS pixel_y, cast(i % 8 AS int) AS pixel_x, cast(v AS double) AS v
FROM (SELECT vec_id, label, posexplode(embedding) AS (i, v) FROM {embeddings}) t""",
    "duckdb": """
SELECT vec_id, label, cast(floor(i / 8e0) AS int) AS pixel_y, cast(i % 8 AS int) AS pixel_x, cast(v AS double) AS v
FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v
      FROM {embeddings}) t""",
}

PREDICTION = """
SELECT event_id, user_id, floor(value) / 1e3 AS score,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
       ln((1e-3 + 998e-3 * (floor(value) / 1e3)) / (1e0 - (1e-3 + 998e-3 * (floor(value) / 1e3)))) AS logit
FROM {events}
"""

METRICS = """
SELECT event_type AS architecture, cast(user_id % 3 + 1 AS int) AS run, max(value) AS iou, count(*) AS n
FROM {events} GROUP BY 1, 2
"""

STATUS = """
SELECT o_orderkey AS fire_id, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'pending' END AS status
FROM {orders}
"""

TZ_REGION = """
SELECT name, lon_min, lon_max, lat_min, lat_max FROM (VALUES ('America/Vancouver', -141e0, -122e0, 48e0, 57e0),
       ('America/Whitehorse', -141e0, -122e0, 57e0, 70e0), ('America/Edmonton', -122e0, -110e0, 48e0, 56e0 + 14e-1))
       AS t(name, lon_min, lon_max, lat_min, lat_max)
"""

# Concave regions, a hole in the first one and an island of another zone inside that hole.
TZ_POLYGON = """
SELECT name, cast(ring AS int) AS ring, cast(seq AS int) AS seq, lon, lat FROM (VALUES
       ('America/Vancouver', 0, 0, -125e0, 55e0), ('America/Vancouver', 0, 1, -1215e-1, 55e0), ('America/Vancouver', 0, 2, -1215e-1, 564e-1),
       ('America/Vancouver', 0, 3, -1226e-1, 569e-1), ('America/Vancouver', 0, 4, -122e0, 572e-1), ('America/Vancouver', 0, 5, -123e0, 58e0),
       ('America/Vancouver', 0, 6, -125e0, 58e0), ('America/Vancouver', 1, 0, -1239e-1, 562e-1), ('America/Vancouver', 1, 1, -1232e-1, 562e-1),
       ('America/Vancouver', 1, 2, -1232e-1, 57e0), ('America/Vancouver', 1, 3, -1236e-1, 5645e-2), ('America/Vancouver', 1, 4, -1239e-1, 57e0),
       ('America/Edmonton', 0, 0, -1215e-1, 55e0), ('America/Edmonton', 0, 1, -119e0, 55e0), ('America/Edmonton', 0, 2, -119e0, 573e-1),
       ('America/Edmonton', 0, 3, -1205e-1, 566e-1), ('America/Edmonton', 0, 4, -1215e-1, 564e-1),
       ('America/Whitehorse', 0, 0, -1238e-1, 5625e-2), ('America/Whitehorse', 0, 1, -1234e-1, 5625e-2), ('America/Whitehorse', 0, 2, -1234e-1, 564e-1))
       AS t(name, ring, seq, lon, lat)
"""

# Footprints as oblique quadrangles, one row per corner.
FOOTPRINT_RING = """
SELECT o_orderkey AS scene_id, cast(o_orderdate AS date) AS acq_date, cast(seq AS int) AS seq,
       -124e0 + (o_custkey % 40) / 1e1 + dx AS lon, 56e0 + (o_orderkey % 15) / 1e1 + dy AS lat
FROM {orders} CROSS JOIN (VALUES (0, -22e-2, -2e-2), (1, 3e-2, -19e-2), (2, 21e-2, 4e-2), (3, -2e-2, 17e-2)) AS c(seq, dx, dy)
"""

# Stations lie anywhere, thinly in the west and densely in the east.
STATION = """
SELECT c_custkey AS station, -119e0 - sqrt((c_custkey * 7919) % 10007 / 10007e0) * 5e0 * ((c_custkey * 31) % 103 / 103e0) AS lon,
       56e0 + (c_custkey * 104729) % 15013 / 1e4 AS lat, c_acctbal AS reading
FROM {customer}
"""

TEXTS: dict[str, str | dict[str, str]] = {
    "burn_points": BURN_POINTS,
    "weather_hourly": WEATHER_HOURLY,
    "weather_sources": WEATHER_SOURCES,
    "veg_composite": VEG_COMPOSITE,
    "scene": SCENE,
    "footprint": FOOTPRINT,
    "scene_pixel": SCENE_PIXEL,
    "raster": RASTER,
    "prediction": PREDICTION,
    "metrics": METRICS,
    "status": STATUS,
    "tz_region": TZ_REGION,
    "tz_polygon": TZ_POLYGON,
    "footprint_ring": FOOTPRINT_RING,
    "station": STATION,
}
ROWS_PER_PARTITION = 1 << 18
_SOURCES = ("lineitem", "events", "orders", "embeddings", "customer")


def _text(name: str, engine: str) -> str:
    text = TEXTS[name]
    return text if isinstance(text, str) else text[engine]


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A fixture as a DataFrame over the parquet files in ``sf_dir``; not spread for a query that deals its rows by a key at once."""
    text = _text(name, "spark")
    read = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in _SOURCES if "{%s}" % s in text}
    used = {s: _spread(source) if spread else source for s, source in read.items()}
    return spark.sql(text, **used)


def _spread(source: DataFrame) -> DataFrame:
    """The derivations multiply small files of a single row group, so rows are spread first, at every size.

    Partitions grow with the rows (counted in the footers), so that no task holds more of them when the table is larger.
    """
    least = source.sparkSession.sparkContext.defaultParallelism
    return source.repartition(max(least, -(-source.count() // ROWS_PER_PARTITION)))


def sql(name: str) -> str:
    """The same fixture as text over the registered views (string is varchar there)."""
    text = _text(name, "duckdb").replace("AS string)", "AS varchar)")
    for source in _SOURCES:
        text = text.replace("{%s}" % source, source)
    return text.strip()
