"""Partitioned tables: weather by month, raster layers by name, metrics and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators.stencil import patch_columns


def write_weather(hourly: DataFrame, path: str) -> None:
    """Hourly cells in one folder per month."""
    month = {"year": F.year("valid_time"), "month": F.month("valid_time")}
    hourly.withColumns(month).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def scan_weather(spark: SparkSession, path: str, months: DataFrame) -> DataFrame:
    """Only the needed months: the semi-join is on partition columns, so other folders are pruned."""
    return spark.read.parquet(path).join(F.broadcast(months), ["year", "month"], "left_semi")


def write_layers(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").partitionBy("layer").parquet(path)


def scan_layers(spark: SparkSession, path: str, layers: list[str]) -> DataFrame:
    """Only the folders of the wanted layers."""
    return spark.read.parquet(path).where(F.col("layer").isin(*layers))


def append_metrics(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append result rows."""
    writer = rows.write.mode("append")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def read_metrics(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def feature_manifest(spark: SparkSession, channels: list[str], patch: int) -> DataFrame:
    """Channel x row offset x column offset in feature order."""
    patch_columns(channels, patch)  # validates the patch size
    r = patch // 2
    names = F.array(*[F.lit(c) for c in channels])
    rows = (
        spark.range(1)
        .select(F.posexplode(names).alias("channel_index", "channel_name"))
        .withColumn("row_offset", F.explode(F.sequence(F.lit(-r), F.lit(r))))
        .withColumn("col_offset", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    )
    position = (F.col("channel_index") * patch + F.col("row_offset") + r) * patch + F.col("col_offset") + r
    return rows.withColumn("feature_index", position)
