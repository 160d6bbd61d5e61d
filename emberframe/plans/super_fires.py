"""Super-fires that grow with the season: each run takes the days it has not seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.operators import graph
from emberframe.session import cut_lineage
from emberframe.sources import day_store


def add_pending(fires: DataFrame, path: str, commit: bool = True) -> None:
    """Join the fires of the pending days (column ``day``) onto the stored super-fires.

    Only new ids and changed labels are written, into the folder of the last pending day. ``commit=False`` stops
    before the record, as a run that breaks off does; the next run takes the same days again.
    """
    spark = fires.sparkSession
    todo = cut_lineage(day_store.pending_days(fires, path), "todo")
    last = todo.agg(F.max("day")).first()[0]
    if last is None:
        return
    batch = cut_lineage(fires.join(todo, "day", "left_semi"), "batch")
    if day_store.committed_days(spark, path) is None:
        labels = batch.select("id", F.col("id").alias("super_id")).limit(0)
    else:
        labels = read_super_fires(spark, path)
    members = cut_lineage(graph.super_fires(batch), "members")
    edges = members.where("id <> super_id").select(F.col("id").alias("u"), F.col("super_id").alias("v"))  # one per fire
    rows = cut_lineage(graph.extend_components(labels, members, edges), "delta")
    day_store.write_days(rows.withColumn("day", F.lit(last)), path)
    if commit:
        day_store.commit_days(todo, path)


def read_super_fires(spark: SparkSession, path: str) -> DataFrame:
    """``(id, super_id)`` of all recorded days, as ``graph.super_fires`` gives them for these days at once."""
    return graph.current_labels(day_store.read_days(spark, path))
