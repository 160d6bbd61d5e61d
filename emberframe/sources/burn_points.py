"""Burn-point CSV files, one per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe import constants as k
from emberframe.session import path_exists

_TYPES = {"ID": T.StringType(), "fireday": T.IntegerType(), "year": T.IntegerType()}
SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.DoubleType())) for c in k.BURN_POINT_COLUMNS])


def with_row_order(raw: DataFrame) -> DataFrame:
    """Add ``row_seq``: file order of a row as one BIGINT, unique over all files.

    A block of a file is read by one task in order. The blocks (one row each) are numbered by path and start;
    a row is placed by its block's number and its distance from the block's first row.
    """
    marked = raw.withColumns({
        "_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id(),
    })
    blocks = marked.groupBy("_path", "_start").agg(F.min("_id").alias("_first"))
    blocks = blocks.withColumn("_block", F.row_number().over(Window.orderBy("_path", "_start")).cast("bigint"))
    # A join dealt by block would bring all rows of a block into one task; there is one row here per block of a file.
    placed = marked.join(F.broadcast(blocks), ["_path", "_start"])
    return placed.withColumn("row_seq", F.shiftleft("_block", 33) + F.col("_id") - F.col("_first")).drop(
        "_path", "_start", "_id", "_first", "_block"
    )


def year_paths(spark: SparkSession, template: str, years: list[int]) -> list[str]:
    """Paths of the years that exist; absent years are skipped."""
    return [p for p in (template.format(year=y) for y in years) if path_exists(spark, p)]


def read_burn_points(
    spark: SparkSession, template: str, years: list[int], columns: tuple[str, ...] = k.BURN_POINT_COLUMNS,
    schema: T.StructType = SCHEMA,
) -> DataFrame:
    """Points of several years with the wanted columns and ``row_seq``.

    ``template`` holds ``{year}``.  Only named columns are parsed; all files form one scan.
    """
    paths = year_paths(spark, template, years)
    if not paths:
        raise FileNotFoundError(f"no burn-point file for {years} at {template}")
    raw = spark.read.option("header", True).schema(schema).csv(paths)
    renamed = {"ID": "id", "DOB": "dob"}
    picked = [F.col(c).alias(renamed.get(c, c)) for c in columns]
    out = with_row_order(raw).select(*picked, "row_seq")
    return out.withColumn("dob", F.col("dob").cast("int")) if "DOB" in columns else out


def union_years(frames: list[DataFrame]) -> DataFrame:
    """Union all of yearly tables by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
