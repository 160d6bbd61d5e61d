"""Tables bucketed by a key: rows are shuffled once, later joins and groups by that key move only the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from emberframe.session import scratch_path


def bucketed(rows: DataFrame, key: str, shuffled: bool = False) -> DataFrame:
    """``rows`` written to the shared folder in as many buckets as the session has shuffle partitions, and read back.

    ``shuffled`` says that rows are dealt by ``key`` already.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "buckets")
    name = f"buckets_{path[-32:]}"
    rows = rows if shuffled else rows.repartition(parts, key)
    rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name)
