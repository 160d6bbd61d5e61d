"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PART_BITS = 8  # a substring of a code is one byte
SHARD_ROWS = 16_384  # vectors that one index holds, about
BLOCK_QUERIES = 2_048  # queries that meet an index at once, about
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def fit_rotations(sample: np.ndarray, rotations: int, steps: int = 30, seed: int = 1) -> list[np.ndarray]:
    """Rotations that bring the sample close to the corners of a cube (iterative quantisation), each from another start."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    centre = sample - sample.mean(axis=0)
    _, _, axes = np.linalg.svd(centre, full_matrices=False)
    axes = np.vstack([axes, np.zeros((dim - len(axes), dim))])
    values, out = centre @ axes.T, []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(steps):
            left, _, right = np.linalg.svd(np.sign(values @ turn).T @ values)
            turn = (left @ right).T
        out.append(axes.T @ turn)
    return out


class Coder:
    """Binary codes of vectors; their bytes are the substrings of the index."""

    def __init__(self, sample: np.ndarray, rotations: int):
        self.mean = sample.mean(axis=0)
        self.planes = np.hstack(fit_rotations(sample, rotations))
        keep = self.planes.shape[1] // PART_BITS * PART_BITS or self.planes.shape[1]
        self.planes = self.planes[:, :keep]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.planes > 0, axis=1)


class MultiIndex:
    """One table per substring: which codes have which value there."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.bounds = np.stack([np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code at most ``radius`` bits away. By the pigeonhole principle it differs in at most radius // parts bits in
        one substring at least, so those values are probed; a full comparison follows."""
        seen, limit = np.zeros(len(self.codes), bool), radius // self.parts
        # Substrings before number radius % parts + 1 need the full limit, the others one bit less.
        for s in range(self.parts):
            most = limit if s <= radius % self.parts else limit - 1
            for v in np.flatnonzero(_NEAR[code[s]] <= most) if most < 3 else ():
                seen[self.order[s, self.bounds[s, v] : self.bounds[s, v + 1]]] = True
            if most >= 3:  # so many values that one look at each code is less work than a list for each value
                seen |= _NEAR[code[s], self.codes[:, s]] <= most
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def _others(found: np.ndarray, ids: np.ndarray, query: int) -> np.ndarray:
    return found[ids[found] != query]


def _products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so that equal vectors get equal scores."""
    return (rows * one).sum(axis=1)


def nearest(
    vectors: DataFrame, is_query: str, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
    rotations: int = 2, sample_rows: int = 20_000, calibration_queries: int = 64, target: float = 0.96,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row that meets the SQL condition ``is_query``.

    1. The rotations are learned from about ``sample_rows`` vectors, chosen by a hash of their id.
    2. The radius is the one that holds ``target`` of the true neighbours of about ``calibration_queries`` queries, which
       are compared with all rows; so it follows the size and shape of the table.
    3. All rows are dealt into indexes of about 16 384 codes, all queries into blocks of about 2 048. Each block meets each index
       in one task of bounded size, which reranks every code within the radius by the full vectors and keeps k per query; where
       fewer than k are that near, the radius grows.

    Vectors that are null, zero, of another length than most or hold a null or non-finite component take no part, nor do
    rows without id; of rows that repeat an id one counts. Other columns are ignored.
    """
    clean = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"),
        F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"),
    ).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    )
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).orderBy(F.desc("n"), "d").first()
    if lengths is None or not lengths["q"]:
        return vectors.sparkSession.createDataFrame([], schema)
    clean = clean.where(F.size("v") == lengths["d"])
    pick = lambda n, of, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * n / of) + 1)
    sample = _matrix(clean.where(pick(sample_rows, lengths["n"], 1)).orderBy("vec_id").select("v").toArrow().column("v"))
    if not len(sample):
        sample = _matrix(clean.limit(1).toArrow().column("v"))
    coder = Coder(sample, rotations)
    radius = _calibrate(clean, coder, clean.where("asks").where(pick(calibration_queries, lengths["q"], 2)), k, target)
    shards, blocks = (-(-n // size) for n, size in ((lengths["n"], SHARD_ROWS), (lengths["q"], BLOCK_QUERIES)))

    def meet(key: tuple, table: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and queries.num_rows:
            ids, first = np.unique(table.column("vec_id").to_numpy(), return_index=True)
            rows = _matrix(table.column("v"))[first]
            index = MultiIndex(coder(rows))
            asked, first = np.unique(queries.column("vec_id").to_numpy(), return_index=True)
            values = _matrix(queries.column("v"))[first]
            for query, one, code in zip(asked, values, coder(values)):
                found, reach = _others(index.within(code, radius), ids, query), radius
                while len(found) < k and reach < 8 * index.parts:  # a lonely query still gets k, or all there are
                    reach += index.parts
                    found = _others(index.within(code, reach), ids, query)
                score = _products(rows[found], one)
                best = _best(ids[found], score, k)
                out.append((np.full(len(best), query), ids[found][best], score[best]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = clean.withColumn("shard", deal(shards, 3)).withColumn("block", each(blocks)).select("shard", "block", "vec_id", "v")
    asking = clean.where("asks").withColumn("block", deal(blocks, 4)).withColumn("shard", each(shards)).select("shard", "block", "vec_id", "v")
    found = base.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(
        meet, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(clean: DataFrame, coder: Coder, queries: DataFrame, k: int, target: float) -> int:
    """The radius that holds ``target`` of the true neighbours of a few queries, from one pass over all rows."""
    asked = queries.select("vec_id", "v").orderBy("vec_id").toArrow()
    if not asked.num_rows:
        asked = clean.where("asks").select("vec_id", "v").orderBy("vec_id").limit(1).toArrow()
    asked_ids, asked_rows = asked.column("vec_id").to_numpy(), _matrix(asked.column("v"))
    codes = coder(asked_rows)

    def closest(batches):
        best = {int(q): [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)] for q in asked_ids}
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
            far = coder(rows)
            for query, one, code in zip(asked_ids, asked_rows, codes):
                other = np.flatnonzero(ids != query)
                score = _products(rows[other], one)
                top = _best(ids[other], score, k)
                bits = np.bitwise_count(far[other[top]] ^ code).sum(axis=1, dtype=np.int64)
                held = [np.r_[a, b] for a, b in zip(best[int(query)], (ids[other[top]], score[top], bits))]
                keep = _best(held[0], held[1], k)
                best[int(query)] = [x[keep] for x in held]
        for query, (ids, score, bits) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_pydict({"query_id": np.full(len(ids), query), "vec_id": ids, "score": score, "bits": bits})

    near = clean.select("vec_id", "v").mapInArrow(closest, "query_id long, vec_id long, score double, bits long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    radius = true.agg(F.percentile("bits", target)).first()[0]
    return 0 if radius is None else int(np.ceil(radius))
