"""Stupid-backoff scores: n-gram counts over all documents, partitioned by hash and joined to the n-grams of each document."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.buckets import bucketed
from emberframe.llm.text import chunks, mix, words
from emberframe.session import cut_lineage

BLOCK_BYTES = 12 << 20  # text of a block of documents, about
RANGE_NGRAMS = 1 << 21  # n-grams in a hash range, about
_STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK = "block long, span int, level int, n int, grams binary, counts binary"


def _ngrams(hashed: np.ndarray, row: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, by length; 0 where the text has too few words before it."""
    none = np.zeros(min(1, len(hashed)), np.uint64)
    value, out = hashed, [mix(hashed + np.uint64(1))]
    for n in range(2, order + 1):
        value = np.r_[none, value[:-1]] * _STEP + hashed
        inside = np.zeros(len(row), bool)
        inside[n - 1 :] = row[n - 1 :] == row[: max(len(row) - n + 1, 0)]
        out.append(np.where(inside, mix(value + np.uint64(n)) | np.uint64(1), np.uint64(0)))
    return out


def _words_of(part: list[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    for batch in part:
        ids = batch.column("doc_id").to_pylist()
        for rows, data, offsets in chunks(batch, "text"):
            hashed, row, _, _ = words(data, offsets)
            yield ids[rows], hashed, row, len(offsets) - 1


def _distinct(part: list[pa.RecordBatch], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct n-grams of a block and their counts, by length."""
    found: list[list[np.ndarray]] = [[] for _ in range(order)]
    for _, hashed, row, _ in _words_of(part):
        for n, grams in enumerate(_ngrams(hashed, row, order)):
            found[n].append(grams[grams != 0])
    return [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in found]


def _spans(grams: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits hash ranges starts in sorted hashes."""
    if not bits:
        return np.array([0, len(grams)])
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[0, np.searchsorted(grams, edges), len(grams)]


def _pack(grams: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as the first one and the differences, each in as many bytes as the largest needs (six for a million)."""
    steps = np.diff(grams)
    wide = (int(steps.max(initial=0)).bit_length() + 7) // 8
    low = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide])
    return bytes([wide]) + grams[:1].astype("<u8").tobytes() + low.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[0], steps[1:, : data[0]] = np.frombuffer(data, np.uint8, 8, 1), np.frombuffer(data, np.uint8, offset=9).reshape(n - 1, data[0])
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count; those that fill it follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


def _count(order: int, bits: int):
    """A block's distinct n-grams and counts, by length and hash range; as length 0 its number of words."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for n, (grams, counts) in enumerate(_distinct(texts.to_batches(), order)):
            if n == 0:
                out.append((0, 0, np.zeros(1, np.uint64), counts.sum(keepdims=True)))
            cut = _spans(grams, bits)
            out += [(span, n + 1, grams[a:b], counts[a:b]) for span, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
        span, level, grams, counts = zip(*out)
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "span": pa.array(span, pa.int32()),
            "level": pa.array(level, pa.int32()), "n": pa.array([len(g) for g in grams], pa.int32()),
            "grams": pa.array([_pack(g) for g in grams], pa.binary()), "counts": pa.array([_pack_counts(c) for c in counts], pa.binary()),
        })

    return run


def _total(key: tuple, table: pa.Table) -> pa.Table:
    """One hash range of one length: the counts over all blocks, handed back to each block in its own order."""
    sizes = table.column("n").to_pylist()
    local = np.concatenate([_unpack_counts(x.as_py(), n) for x, n in zip(table.column("counts"), sizes)])
    grams, place = np.unique(np.concatenate([_unpack(x.as_py(), n) for x, n in zip(table.column("grams"), sizes)]), return_inverse=True)
    total = np.bincount(place, weights=local, minlength=len(grams)).astype(np.int64)
    back = np.split(total[place], np.cumsum(sizes)[:-1])
    return pa.table({
        "block": table.column("block"), "span": table.column("span"), "level": table.column("level"), "n": table.column("n"),
        "grams": pa.array([b""] * len(sizes), pa.binary()), "counts": pa.array([_pack_counts(b) for b in back], pa.binary()),
    })


def _score(order: int, alpha: float, min_count: int):
    def run(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
        part = texts.to_batches()
        known = _distinct(part, order)
        table = [np.zeros(len(g), np.int64) for g, _ in known]
        corpus_words = 0
        rows = sorted(zip(*(totals.column(c).to_pylist() for c in ("level", "span", "n")), range(totals.num_rows)))
        held = lambda wanted: [_unpack_counts(totals.column("counts")[k].as_py(), n) for level, _, n, k in rows if level == wanted]
        for n in range(order):
            if mine := held(n + 1):
                table[n] = np.concatenate(mine)
        if whole := held(0):
            corpus_words = int(whole[0][0])
        out: list[list] = [[], [], [], []]
        for ids, hashed, row, n_rows in _words_of(part):
            grams = _ngrams(hashed, row, order)
            count = []
            for n, g in enumerate(grams):
                at = np.minimum(np.searchsorted(known[n][0], g), max(len(known[n][0]) - 1, 0))
                count.append(np.where(g != 0, table[n][at], 0) if len(table[n]) else np.zeros(len(g), np.int64))
            value = np.log(np.maximum(count[0], 1) / max(corpus_words, 1))
            used = np.ones(len(hashed), np.int64)
            longest = np.ones(len(hashed), np.int64)
            for n in range(1, order):
                # The context ends one word earlier; only contexts inside the text exist.
                context = np.r_[np.zeros(min(1, len(hashed)), np.int64), count[n - 1][:-1]]
                exists = grams[n] != 0
                good = exists & (count[n] >= min_count)
                higher = np.log(np.maximum(count[n], 1) / np.maximum(context, 1))
                value = np.where(good, higher, np.where(exists, value + log(alpha), value))
                used, longest = np.where(good, n + 1, used), np.where(exists, n + 1, longest)
            total = np.bincount(row, weights=value, minlength=n_rows)
            out[0] += ids
            out[1].append(np.bincount(row, minlength=n_rows))
            out[2].append(total)
            out[3].append(np.bincount(row, weights=used < longest, minlength=n_rows).astype(np.int64))
        return pa.table({
            "doc_id": pa.array(out[0], pa.int64()), "n_words": np.concatenate(out[1]).astype(np.int64),
            "log_score": np.concatenate(out[2]), "n_backoff": np.concatenate(out[3]),
        }) if out[0] else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                                    "log_score": pa.array([], pa.float64()), "n_backoff": pa.array([], pa.int64())})

    return run


def stupid_backoff(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", order: int = 2, alpha: float = 0.4, min_count: int = 2,
) -> DataFrame:
    """doc_id, n_words, log_score, n_backoff: the log score of every document under n-gram counts over all of them.

    A word after a context c of up to ``order`` - 1 words scores count(c word) / count(c) if the n-gram is in the table, that is
    occurs at least ``min_count`` times; else ``alpha`` times its score after the context without its first word; without context,
    its share of all words. Words of a text have no context beyond it. ``n_backoff`` counts words that did not use their longest
    context. Letters A-Z are lower-cased.

    Rows are dealt at random (by a hash of their place in the input) into blocks of about 12 MB. A block sends its distinct n-grams with
    their counts to hash ranges, each of bounded size however common an n-gram is; a range adds up the counts and
    hands each block the totals of its own n-grams, which the block joins to its texts. N-grams go by a 64-bit hash.

    A null, empty or blank text has no words and score 0; a row without id keeps a null id; repeated rows count
    and are scored each; other columns are ignored; an empty table gives an empty result.
    """
    whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text").cast("long")).alias("b"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size["b"] or 0) // BLOCK_BYTES))
    bits = max(0, ((size["b"] or 0) // 6 // RANGE_NGRAMS).bit_length())
    dealt = whole.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    texts = bucketed(dealt, "block")
    local = texts.groupBy("block").applyInArrow(_count(order, bits), BLOCK)
    totals = cut_lineage(local.groupBy("span", "level").applyInArrow(_total, BLOCK), "totals")
    return texts.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _score(order, alpha, min_count), "doc_id long, n_words long, log_score double, n_backoff long"
    )
