"""Sample export, manifest and ingestion of published sample archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions import geo
from emberframe.operators.ranking import rank_by_prefix

MANIFEST_ENTRY = "struct<tile_id:string,fireday:int,primary_fire_id:string>"


def export_samples(packed: DataFrame, path: str) -> None:
    """Packed samples, narrow types, one folder per split."""
    packed.write.mode("overwrite").partitionBy("split").parquet(path)


def sample_manifest(samples: DataFrame) -> DataFrame:
    """``sample_<n>.npz`` per split in (year, day, tile) order, with tile, fire day and primary fire."""
    numbered = rank_by_prefix(samples, ["year", "dob"], ["tile_col", "tile_row"], "_n", group=["split"])
    name = F.concat(F.lit("sample_"), (F.col("_n") - 1).cast("string"), F.lit(".npz"))
    return numbered.select(
        "split", name.alias("sample"), geo.tile_id().alias("tile_id"),
        F.col("primary_fireday").alias("fireday"), F.col("primary_fire").alias("primary_fire_id"),
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON dictionary entry per line, in a folder per split."""
    entry = F.create_map("sample", F.struct("tile_id", "fireday", "primary_fire_id"))
    manifest.select("split", F.to_json(entry).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def read_manifest(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    text = spark.read.text(path, wholetext=whole_file)
    keep = [c for c in text.columns if c != "value"]
    rows = text.select(*keep, F.explode(F.from_json("value", f"map<string,{MANIFEST_ENTRY}>")).alias("sample", "s"))
    return rows.select(*keep, "sample", "s.*")


def _channel_names(n: int) -> list[str]:
    return list(k.CHANNELS) if n == len(k.CHANNELS) else [f"c{i}" for i in range(n)]


def decode_archives(files: DataFrame, channels: int = len(k.CHANNELS)) -> DataFrame:
    """``(path, content)`` archives to pixel rows ``(sample, step, pixel_y, pixel_x, <channels>, label)``.

    One archive is one sample (at most a few megabytes); Spark spreads the files over tasks and
    the arrays become Arrow batches step by step.  A simple sample has step 0.
    """
    names = _channel_names(channels)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as data:
                    x, y = np.asarray(data["x"], dtype=np.float32), np.asarray(data["y"])
                steps = x[None] if x.ndim == 3 else x
                if steps.ndim != 4 or steps.shape[1] != channels or steps.shape[2:] != y.shape:
                    raise ValueError(f"unexpected shapes {x.shape} and {y.shape} in {path}")
                rows, cols = np.indices(y.shape)
                for step, planes in enumerate(steps):
                    frame = {"sample": path, "step": step, "pixel_y": rows.ravel(), "pixel_x": cols.ravel()}
                    frame |= {n: planes[i].ravel() for i, n in enumerate(names)}
                    yield pd.DataFrame(frame | {"label": y.ravel()})

    fields = ", ".join(f"{n} float" for n in names)
    schema = f"sample string, step int, pixel_y int, pixel_x int, {fields}, label smallint"
    return files.select("path", "content").mapInPandas(decode, schema)


def encode_archives(packed: DataFrame, channels: int) -> DataFrame:
    """Packed samples ``(sample, height, x, y)`` to archive bytes ``(path, content)``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, y, height in zip(batch["x"], batch["y"], batch["height"]):
                buffer = io.BytesIO()
                planes = np.asarray(x, dtype=np.float16).reshape(channels, height, -1)
                np.savez(buffer, x=planes, y=np.asarray(y, dtype=np.uint8).reshape(height, -1))
                out.append(buffer.getvalue())
            yield pd.DataFrame({"path": batch["sample"], "content": out})

    return packed.select("sample", "height", "x", "y").mapInPandas(encode, "path string, content binary")


def ingest_archives(spark: SparkSession, folder: str, channels: int = len(k.CHANNELS)) -> DataFrame:
    """All ``.npz`` archives below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True)
    return decode_archives(files.load(folder), channels)
