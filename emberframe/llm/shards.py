"""Blocks of queries against shards of rows: every shard is held once, in bounded memory, and the queries stream past it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 262_144  # rows that one shard holds, about, however large the table
LEAST_SHARD_ROWS = 4_096
SHARDS = 64  # a smaller table is dealt into so many shards, as far as they keep LEAST_SHARD_ROWS


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, *extra: str, scale: int = 256) -> tuple[DataFrame, int, int]:
    """(rows vec_id, v and the columns ``extra``; their number; their length): ``v`` is floor(scale * x) of every component, as INT.

    Rows without id take no part, nor do vectors that are null, hold null or non-finite components, or have another length than most
    (of lengths equally frequent the smaller counts), nor vectors with an integer component so large that an inner product might
    not fit 64 bits (beyond 2**28 at 64 components), nor rows where an ``extra`` column is null.
    """
    doubles = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"), *extra
    ).dropna(subset=["vec_id", *extra]).where("x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('inf'))")
    most = doubles.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows, length = (most["count"], most["length"]) if most else (0, 0)
    limit = min(1 << 30, int((2**62 / max(length, 1)) ** 0.5))
    scaled = doubles.where(F.size("x") == length).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("w"), *extra)
    kept = scaled.where(F.forall("w", lambda c: (c >= -limit) & (c <= limit)))
    return kept.select("vec_id", F.col("w").cast("array<int>").alias("v"), *extra), rows, length


def number_of_shards(rows: int) -> int:
    size = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, rows // SHARDS))
    return max(1, -(-rows // size))


def shard_of(shards: int):
    return F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).cast("int")


def meet(
    rows: DataFrame, queries: DataFrame, shards: int, length: int,
    build: Callable[[np.ndarray, np.ndarray, np.ndarray], object],
    answer: Callable[[object, np.ndarray, np.ndarray, list[np.ndarray]], Iterable[pa.RecordBatch]], schema: str, own_shard: bool = False,
) -> DataFrame:
    """What ``answer`` yields for every query and shard (``own_shard``: for every query and the shard of its own id alone).

    ``rows`` and ``queries`` have the columns vec_id, v and extra, an ARRAY of LONG. Rows are shuffled once and a query once per shard; inside a
    partition the rows of a shard come first and are handed to ``build`` as (ids, vectors, first of extra), ids ascending, then its
    queries pass in batches. A task so holds one shard and one batch. Of rows that repeat an id the one with the least vector,
    then the least extra, counts, on both sides.
    """
    base = rows.select(shard_of(shards).alias("shard"), F.lit(0).alias("kind"), "vec_id", "v", "extra")
    where = shard_of(shards) if own_shard else F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(where.alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", "extra")
    dealt = base.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id", "v", "extra")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, last = None, [], None, None
        for batch in batches:
            shard, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            values = np.asarray(batch.column(3).flatten()).reshape(len(ids), length)
            extra, bounds = np.asarray(batch.column(4).flatten()), _offsets(batch.column(4))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(ids)]):
                part = (int(shard[lo]), int(kind[lo]))
                new = ids[lo:hi] != np.r_[ids[lo] if last == (part, ids[lo]) else ids[lo] - 1, ids[lo : hi - 1]]
                last, use = (part, ids[hi - 1]), lo + np.flatnonzero(new)
                if at != part[0]:
                    at, held, index = part[0], [], None
                if part[1] == 0:
                    first = np.where(bounds[use + 1] > bounds[use], np.r_[extra, 0][bounds[use]], 0)
                    held.append((ids[use], values[use], first))
                elif held and len(use):
                    if index is None:
                        index = build(*(np.concatenate(c) for c in zip(*held)))
                    yield from answer(index, ids[use], values[use], [extra[bounds[i] : bounds[i + 1]] for i in use])

    return dealt.mapInArrow(stream, schema)


def _offsets(column: pa.ListArray) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0]


def columns(schema: str, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """One batch of LONG columns from the pieces of an answer."""
    if parts:
        names = [field.split()[0] for field in schema.split(", ")]
        yield pa.RecordBatch.from_pydict({n: np.concatenate(c).astype(np.int64) for n, c in zip(names, zip(*parts))})
