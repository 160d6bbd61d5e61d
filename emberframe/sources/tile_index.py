"""JSON form of the tile/day overlap index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.functions import geo
from emberframe.operators.tiles import TILE_DAY

ENTRY = "array<struct<fire_id:string,day_key:string>>"


def write_tile_fires_json(packed: DataFrame, path: str) -> None:
    """Dictionaries ``{key: [{fire_id, day_key}]}``, one object per line and tile-day.

    Nothing is collected beyond the fires that a key lists.
    """
    key = geo.tile_key(F.col("tile_id"), F.col("year"), F.col("dob"))
    fires = F.transform("fires", lambda f: F.struct(f["fire_id"].alias("fire_id"), f["day_key"].alias("day_key")))
    lines = packed.select("year", F.to_json(F.create_map(key, fires)).alias("value"))
    lines.write.mode("overwrite").partitionBy("year").text(path)


def read_tile_fires_json(spark: SparkSession, paths: list[str], whole_file: bool = False) -> DataFrame:
    """Index dictionaries as rows ``(year, tile_col, tile_row, dob, id, fireday, first_seq, source)``.

    ``whole_file`` reads a pretty-printed dictionary that fills a file; otherwise every line is one.
    """
    frames = []
    for order, path in enumerate(paths):
        text = spark.read.text(path, wholetext=whole_file).select("value")
        frames.append(text.withColumn("source", F.lit(order)))
    text = reduce(DataFrame.unionByName, frames)
    entries = text.select(
        "source", F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("key", "fires")
    )
    parts = geo.parse_tile_key(F.col("key"))
    rows = entries.select(
        "source", *[parts[c].alias(c) for c in TILE_DAY], F.posexplode("fires").alias("first_seq", "f")
    )
    return rows.select(
        *TILE_DAY, F.col("f.fire_id").alias("id"),
        F.regexp_extract("f.day_key", r"^day_(\d+)$", 1).cast("int").alias("fireday"),
        F.col("first_seq").cast("bigint").alias("first_seq"), "source",
    )


def later_source_wins(index: DataFrame, keys: tuple[str, ...] = TILE_DAY, source: str = "source") -> DataFrame:
    """Dictionary update: the last source that has a key supplies all of its rows."""
    winner = index.groupBy(*keys).agg(F.max(source).alias(source))
    return index.join(winner, [*keys, source], "left_semi").drop(source)
