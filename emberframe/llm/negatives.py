"""Hard negatives by exact scores from Four-Russians tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.shards import columns, integer_vectors, meet, number_of_shards
from emberframe.session import cut_lineage

ANCHORS = 128  # anchors whose tables are held at once
ROWS = 1_024  # candidates scored at once
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


class BitPlanes:
    """Candidates as packed bits: one byte per plane and group of eight dimensions, least plane first, in two's complement."""

    def __init__(self, vectors: np.ndarray):
        low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
        self.planes = max(high.bit_length(), (-1 - low).bit_length() if low < 0 else 0) + 1
        self.largest = max(-low, high)
        padded = np.zeros((len(vectors), -(-vectors.shape[1] // 8) * 8), np.int32)
        padded[:, : vectors.shape[1]] = vectors
        self.bytes = np.stack([np.packbits((padded >> j & 1).astype(np.uint8), axis=1, bitorder="little") for j in range(self.planes)])


def subset_sums(anchors: np.ndarray, largest: int) -> np.ndarray:
    """Table [group, byte, anchor]: the sum of the anchor's components that the bits of the byte choose from the group's eight.

    32-bit numbers where no score against components up to ``largest`` can pass them, else 64-bit ones.
    """
    fits = int(np.abs(anchors).max(initial=0)) * anchors.shape[1] * 2 * (largest + 1) < 1 << 31
    groups = -(-anchors.shape[1] // 8)
    padded = np.zeros((groups * 8, len(anchors)), np.int32 if fits else np.int64)
    padded[: anchors.shape[1]] = anchors.T
    sums = np.zeros((groups, 256, len(anchors)), padded.dtype)
    for bit in range(8):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + padded[bit::8][:, None]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor] of every pair: from the sign plane down, double and add the looked-up sums."""
    total = None
    for plane in planes[::-1]:
        part = sums[0][plane[:, 0]]
        for group in range(1, len(sums)):
            part += sums[group][plane[:, group]]
        total = -part if total is None else (total << 1) + part
    return total


class Shard:
    """Candidates of a shard, ordered by label and id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.bits = ids[order], labels[order], BitPlanes(vectors[order])

    def score(self, anchors: np.ndarray, first: int, last: int) -> np.ndarray:
        """Scores [anchor, candidate] of the candidates first to last."""
        sums, planes = subset_sums(anchors, self.bits.largest), self.bits.bytes
        if first == last or not sums.shape[0]:
            return np.zeros((len(anchors), last - first), np.int64)
        parts = [scores(planes[:, at : min(at + ROWS, last)], sums).T for at in range(first, last, ROWS)]
        return np.ascontiguousarray(np.hstack(parts))


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def _positives(index: Shard, ids: np.ndarray, values: np.ndarray, labels: np.ndarray, k: int) -> list[tuple]:
    out = []
    for label in np.unique(labels):
        first, last = np.searchsorted(index.labels, [label, label + 1])
        mine = np.flatnonzero(labels == label)
        for block in np.split(mine, range(ANCHORS, len(mine), ANCHORS)):
            for anchor, score in zip(block, index.score(values[block], first, last)):
                other = np.flatnonzero(index.ids[first:last] != ids[anchor])
                best = other[_first(score[other], index.ids[first:last][other], k)]
                out.append((np.full(len(best), ids[anchor]), index.ids[first:last][best], score[best]))
    return out


def _negatives(index: Shard, ids: np.ndarray, values: np.ndarray, extra: list[np.ndarray], k: int, low: int, high: int) -> list[tuple]:
    out = []
    for block in np.split(np.arange(len(ids)), range(ANCHORS, len(ids), ANCHORS)):
        for anchor, score in zip(block, index.score(values[block], 0, len(index.ids))):
            pairs = extra[anchor][1:].reshape(-1, 2)
            least, most = -(-low * pairs[:, 1] // 100), high * pairs[:, 1] // 100
            usable = np.flatnonzero((score >= least.min()) & (score <= most.max()) & (index.labels != extra[anchor][0]))
            usable = usable[np.lexsort((index.ids[usable], -score[usable]))]
            falling = -score[usable].astype(np.int64)
            for (positive, its), start, end in zip(pairs, np.searchsorted(falling, -most), np.searchsorted(falling, -least, side="right")):
                chosen = usable[start : min(end, start + k)]
                out.append((
                    np.full(len(chosen), ids[anchor]), np.full(len(chosen), positive), np.full(len(chosen), its),
                    index.ids[chosen], score[chosen],
                ))
    return out


def hard_negatives(
    vectors: DataFrame, is_anchor: str, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows that meet the SQL condition ``is_anchor``.

    A score is the integer inner product of two rows, components as floor(scale * x). An anchor's positives are its
    ``positives`` best-scoring other rows of the same label; the negatives of a positive are the ``negatives`` best rows of another
    label that score between ``low`` and ``high`` per cent of it. Ties go to smaller ids.

    Every score is exact: a shard keeps its candidates as bit planes, one byte per plane and eight dimensions; for a block of anchors
    the sums of all 256 subsets of each eight components are tabulated, and a score is the shifted sum of looked-up entries. A first
    pass scores anchors against rows of their own label, a second one against all rows.

    Rows with a null label or id take no part, nor do the vectors that ``integer_vectors`` leaves out; of rows that repeat an id the one
    with the least vector, then the least label, counts. A positive with a negative score has no negatives, as no score lies in its
    range. An empty table, or no anchors, gives an empty result. Other columns are ignored, whatever their names.
    """
    asks = F.coalesce(F.expr(is_anchor), F.lit(False)).alias("_asks")
    named = vectors.select(id_column, vector_column, F.col(label_column).cast("long").alias("_label"), asks)
    flagged, count, length = integer_vectors(named, id_column, vector_column, "_label", "_asks", scale=scale)
    rows = flagged.withColumn("extra", F.array("_label"))
    shards = number_of_shards(count)
    anchors = rows.where("_asks")

    def near(index: Shard, ids, values, extra):
        yield from columns(POSITIVES, _positives(index, ids, values, np.array([e[0] for e in extra]), positives))

    def hard(index: Shard, ids, values, extra):
        yield from columns(NEGATIVES, _negatives(index, ids, values, extra, negatives, low, high))

    found = meet(rows, anchors, shards, length, Shard, near, POSITIVES)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    pairs = cut_lineage(best.groupBy("anchor_id").agg(
        F.flatten(F.transform(
            F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))), lambda p: F.array(p["positive_id"], p["positive_score"])
        )).alias("pairs")
    ), "positives")
    # A repeated anchor id joins with the same pairs; meet() keeps the row that the first pass kept.
    asked = anchors.join(pairs, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "v", F.concat("extra", "pairs").alias("extra"))
    mined = meet(rows, asked, shards, length, Shard, hard, NEGATIVES)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
