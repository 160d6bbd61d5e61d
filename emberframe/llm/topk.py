"""Exact top-k search by inner product, pruned by segment means and deviations at several resolutions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.shards import columns, integer_vectors, meet, number_of_shards
from emberframe.session import cut_lineage

SEGMENTS = (16, 4, 2)  # lengths of the segments, coarse to fine
STEP = 256  # survivors whose exact distance is computed at once
LOWEST = -(1 << 62)
SCHEMA = "query_id long, vec_id long, score long"


def segment_statistics(vectors: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments of each row, weighted so that the inner product of two rows of statistics is at least
    the inner product of the rows themselves.

    In a segment of m components, <q, x> = m * mean(q) * mean(x) + <q - mean(q), x - mean(x)>, and the last term is at most
    m * dev(q) * dev(x). The squared distance is |q|^2 + |x|^2 - 2 <q, x>, so the same sum is its lower bound, and the largest inner
    product is the least of the distances -<q, x>.
    """
    rows, dim = vectors.shape
    padded = np.zeros((rows, -(-dim // length) * length))
    padded[:, :dim] = vectors
    cut = padded.reshape(rows, -1, length)
    return np.hstack([cut.mean(axis=2), cut.std(axis=2)]) * np.sqrt(length)


class SegmentIndex:
    """Vectors of a shard with their statistics at each resolution."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, np.abs(vectors).max(initial=0)
        self.vectors = vectors.astype(np.int64)
        self.doubles = vectors.astype(np.float64)
        self.levels = [segment_statistics(vectors, length) for length in SEGMENTS]
        self.norm = float(np.sqrt((self.doubles**2).sum(axis=1)).max(initial=0))

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles while every partial sum stays below 2**53, else in 64-bit integers."""
        if int(self.exact) * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53:
            return (self.doubles[rows] @ query.astype(np.float64)).astype(np.int64)
        return (self.vectors[rows] * query.astype(np.int64)).sum(axis=1)

    def top(self, query_id: int, query: np.ndarray, levels: list[np.ndarray], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the shard whose score is ``floor`` at least, ties to smaller ids."""
        slack = 1e-12 * (1 + len(query)) * (1 + self.norm) * (1 + float(np.sqrt((query.astype(np.float64) ** 2).sum())))
        alive = np.flatnonzero(self.ids != query_id)
        bound = np.zeros(0)
        for mine, its in zip(self.levels, levels):
            bound = (mine @ its)[alive] if 2 * len(alive) > len(mine) else mine[alive] @ its
            keep = bound >= floor - slack
            alive, bound = alive[keep], bound[keep]
        order = np.argsort(-bound, kind="stable")
        ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first in range(0, len(order), STEP):
            if bound[order[first]] < floor - slack:
                break
            rows = alive[order[first : first + STEP]]
            ids, score = np.r_[ids, self.ids[rows]], np.r_[score, self.products(rows, query)]
            best = np.lexsort((ids, -score))[:k]
            ids, score = ids[best], score[best]
            if len(score) == k:
                floor = max(floor, int(score[-1]))
        keep = score >= floor
        return ids[keep], score[keep]


def top_k(
    vectors: DataFrame, is_query: str, *, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products, exactly, for each row that meets the SQL condition ``is_query``.

    Components count as floor(scale * x). All rows are dealt into shards by a hash of their id. First each query meets the shard of
    its own id, which gives it a floor under its k-th best score; then it meets every shard with that floor. In a shard the bounds
    of 16-, 4- and 2-component segments drop rows in turn, and the survivors' scores are computed in the order of their bounds, until
    the bound falls below the k-th best. Bounds carry a slack for rounding, scores are exact, and no row is dropped otherwise.

    ``integer_vectors`` says which vectors take no part. Fewer than k candidates: all of them. Of rows that repeat an id one counts.
    An empty table, or no queries, gives an empty result. Other columns are ignored, whatever their names.
    """
    asks = F.coalesce(F.expr(is_query), F.lit(False)).alias("_asks")
    flagged, count, length = integer_vectors(vectors.select(id_column, vector_column, asks), id_column, vector_column, "_asks", scale=scale)
    rows = flagged.withColumn("extra", F.array().cast("array<long>"))
    shards = number_of_shards(count)

    def build(ids: np.ndarray, values: np.ndarray, _: np.ndarray) -> SegmentIndex:
        return SegmentIndex(ids, values)

    def best(index: SegmentIndex, ids, values, floors, partial: bool):
        levels = [segment_statistics(values, size) for size in SEGMENTS]
        out = []
        for i, (query_id, query) in enumerate(zip(ids, values)):
            found, score = index.top(query_id, query, [level[i] for level in levels], k, LOWEST if partial else int(floors[i][0]))
            out.append((np.full(len(found), query_id), found, score))
        return out

    def floor(index: SegmentIndex, ids, values, _):
        found = best(index, ids, values, None, True)
        yield from columns("query_id long, floor long", [
            (ids, np.array([score[-1] if len(score) == k else LOWEST for _, _, score in found])),
        ])

    def answer(index: SegmentIndex, ids, values, floors):
        yield from columns(SCHEMA, best(index, ids, values, floors, False))

    asked = rows.where("_asks")
    floors = cut_lineage(meet(rows, asked, shards, length, build, floor, "query_id long, floor long", own_shard=True), "floors")
    # Rows that repeat an id carry the same floor; meet() then keeps one of them.
    queries = asked.join(floors, F.col("vec_id") == F.col("query_id")).select("vec_id", "v", F.array("floor").alias("extra"))
    found = meet(rows, queries, shards, length, build, answer, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
