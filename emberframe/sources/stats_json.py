"""Feature statistics as one JSON dictionary (one entry per feature)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "struct<mean:double,std:double,min:double,max:double,count:bigint>"


def write_feature_stats(stats: DataFrame, path: str) -> None:
    entry = F.struct(F.col("feature"), F.struct("mean", "std", "min", "max", "count"))
    line = stats.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    line.write.mode("overwrite").text(path)


def read_feature_stats(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{_ENTRY}>")).alias("feature", "s")).select("feature", "s.*")
