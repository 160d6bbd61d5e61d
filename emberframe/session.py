"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []  # scratch tables of this process

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hash instead of sort-merge joins where the measured build partitions are small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "emberframe", **overrides: str) -> SparkSession:
    """A session with the settings the operators assume; overrides win over the defaults."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A local-mode session without that setting uses a folder below its warehouse; on a cluster a
    missing setting is an error, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to a table in the shared folder and return a plan that starts there.

    The table survives lost executors, is computed once, and its size is known to the planner,
    so small intermediate results get broadcast joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (or at least one match of a glob) exists on its file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder; plans that start there end with it."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in _WRITTEN:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name), True)
    _WRITTEN.clear()
