"""Tables that grow day by day: one folder per day, and a record of the days that are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.session import path_exists


def committed_days(spark: SparkSession, path: str) -> DataFrame | None:
    """Distinct days with a commit record, or None before the first one."""
    if not path_exists(spark, f"{path}/commits/*.parquet"):
        return None
    return spark.read.parquet(f"{path}/commits").select("day").distinct()


def pending_days(days: DataFrame, path: str) -> DataFrame:
    """The days (column ``day``) that the table does not hold yet: never written, or broken off before their record."""
    done = committed_days(days.sparkSession, path)
    wanted = days.select("day").distinct()
    return wanted if done is None else wanted.join(done, "day", "left_anti")


def write_days(rows: DataFrame, path: str) -> None:
    """Replace the folders of the days in ``rows``; folders of other days stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/days")


def commit_days(days: DataFrame, path: str) -> None:
    """Record that the folders of ``days`` are whole. Comes last: a run that breaks off before it is simply repeated."""
    days.select("day").distinct().coalesce(1).write.mode("append").parquet(f"{path}/commits")


def add_days(rows: DataFrame, days: DataFrame, path: str) -> None:
    """Write the rows of the pending ``days`` and record them; days without rows are recorded too."""
    write_days(rows, path)
    commit_days(days, path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Rows of recorded days. The join is on the folder column, so folders without a record are not opened."""
    done = committed_days(spark, path)
    if done is None:
        raise ValueError(f"{path} has no complete day")
    return spark.read.option("basePath", f"{path}/days").parquet(f"{path}/days").join(done, "day", "left_semi")
