"""Resume by status: skip what succeeded, retry what failed, record the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(log: DataFrame, key: str = "fire_id", order: str = "run") -> DataFrame:
    """Last recorded status per key."""
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"))


def pending_work(work: DataFrame, log: DataFrame, key: str = "fire_id", order: str = "run") -> DataFrame:
    """Work whose latest status is not success (never run, failed or interrupted)."""
    done = latest_status(log, key, order).where(F.col("status") == "success")
    return work.join(done, key, "left_anti")


def outcome_rows(processed: DataFrame, failed: DataFrame, run: int, key: str = "fire_id") -> DataFrame:
    """Rows to append to the log after a run."""
    bad = failed.select(key).distinct().withColumn("_bad", F.lit(True))
    status = F.when(F.col("_bad"), "failed").otherwise("success")
    return processed.select(key).join(bad, key, "left").select(key, F.lit(run).alias("run"), status.alias("status"))
