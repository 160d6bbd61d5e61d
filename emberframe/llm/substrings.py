"""Exact substring deduplication: ranks of growing substrings at sampled positions, sorted until unique or long enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.buckets import bucketed
from emberframe.llm.text import chunks, mix
from emberframe.session import cut_lineage

LENGTH = 100
RUN = "key long, full long, doc_id long, start long, n int"

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_PLACE = np.uint64((1 << 31) - 1)


class Names:
    """Names of the substrings of a chunk: a name of length 2k is made from the names of its halves.

    Equal substrings have equal names; different ones differ but for one case in 2**64. Any length between k and 2k is
    named by two overlapping names of length k.
    """

    def __init__(self, data: np.ndarray):
        self.level = [_BYTE[data]]

    def power(self, k: int) -> np.ndarray:
        while len(self.level) <= k:
            last, step = self.level[-1], 1 << (len(self.level) - 1)
            if len(last) <= step:
                self.level.append(last[:0])
                continue
            new = last[:-step] * _ODD[len(self.level) % 5]
            new += last[step:]
            new ^= new >> np.uint64(32)
            self.level.append(new)
        return self.level[k]

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Names of the substrings of ``length`` that start at ``places``."""
        k = length.bit_length() - 1
        base = self.power(k)
        return mix(base[places] * _ODD[0] + base[places + length - (1 << k)] * _ODD[1] + np.uint64(length))


def _windows(offsets: np.ndarray, length: int) -> np.ndarray:
    """Which places of a chunk start a window of ``length`` bytes inside one row."""
    n = int(offsets[-1])
    if n < length:
        return np.zeros(0, bool)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(step, offsets[1:], -1)
    return (np.cumsum(step[:n]) == 0)[: n - length + 1]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(names: Names, offsets: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of the runs of windows that choose the same anchor.

    A window's anchor is the place, in it, of the substring of ``core`` bytes whose name is least (the first such). Equal windows
    choose equal anchors, wherever they stand.
    """
    good = _windows(offsets, length)
    if not good.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    name = names.power(core.bit_length() - 1)
    order = (name * np.uint64(0xFF51AFD7ED558CCD)) & ~_PLACE | np.arange(len(name), dtype=np.uint64)
    anchor = (_sliding_min(order, length - core + 1) & _PLACE).astype(np.int64)
    change = np.r_[True, anchor[1:] != anchor[:-1]]
    first = good & change
    first[1:] |= good[1:] & ~good[:-1]
    last = good & np.r_[change[1:], True]
    last[:-1] |= good[:-1] & ~good[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return anchor[first], first, last


def _batch(key, full, doc, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), pa.array(doc), pa.array(start), pa.array(n.astype(np.int32))],
        names=["key", "full", "doc_id", "start", "n"],
    )


def _sample(length: int, core: int):
    """Runs of windows of a chunk with the name of their common core (key) and of all they cover (full).

    Of runs that a chunk repeats only the first travels under its key; the others are known to be
    repetitions and travel under a key of their own with n < 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, data, offsets in chunks(batch, "text"):
                names = Names(data)
                anchor, first, last = _runs(names, offsets, length, core)
                if not len(first):
                    continue
                key = names.at(anchor, core)
                whole = names.at(first, length) * _ODD[2] + names.at(last, length) * _ODD[3]
                full = mix(whole + ((anchor - first) << 8 | (last - first)).astype(np.uint64))
                row = np.searchsorted(offsets, first, side="right") - 1
                doc, start, n = ids[rows][row], first - offsets[row], last - first + 1
                order = np.lexsort((start, doc, full, key))
                again = np.r_[False, (key[order][1:] == key[order][:-1]) & (full[order][1:] == full[order][:-1])]
                repeated = np.zeros(len(order), bool)
                repeated[order] = again
                n = np.where(repeated, -n, n)
                key = np.where(repeated, mix(doc.astype(np.uint64) * _ODD[0] + start.astype(np.uint64)), key)
                yield _batch(key, full, doc, start, n)

    return run


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, full, doc_id, start). Out: repetitions (check = false) and rows to look at more closely (true).

    A row like the one before repeats it. The first rows of their kind go on if their key has another kind;
    all else is unique and drops out.
    """
    names = ("key", "full", "doc_id", "start", "n")
    held, told = None, True
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
        known = cols[4] < 0
        rows = np.stack(cols)
        marked, rows = rows[:, known], rows[:, ~known]
        start = 0
        if held is not None:
            rows = np.concatenate([held, rows], axis=1)
            start = 1
        if not rows.shape[1]:
            out, check = marked, np.zeros(marked.shape[1], bool)
        else:
            same_key = np.r_[False, rows[0, 1:] == rows[0, :-1]]
            same = same_key & np.r_[False, rows[1, 1:] == rows[1, :-1]]
            repeats = np.flatnonzero(same)
            heads = np.flatnonzero(~same)
            # Of the row held back only the first of its kind was kept, so heads[0] is 0 in any case.
            twin = np.r_[rows[0, heads[1:]] == rows[0, heads[:-1]], False]
            go = twin | np.r_[False, twin[:-1]]
            if start and told:
                go[0] = False
            tail_told = bool(go[-1]) or (start == 1 and len(heads) == 1 and told)
            out = np.concatenate([marked, rows[:, repeats], rows[:, heads[go]]], axis=1)
            check = np.r_[np.zeros(marked.shape[1] + len(repeats), bool), np.ones(int(go.sum()), bool)]
            held, told = rows[:, heads[-1:]], tail_told
        if out.shape[1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[2]), pa.array(out[3]), pa.array(np.abs(out[4]).astype(np.int32)), pa.array(check)],
                names=["doc_id", "start", "n", "check"],
            )


def _closer(length: int, core: int):
    """Runs to look at again, cut into blocks with a common core of ``core`` bytes, at offsets that equal windows share."""
    block = length - core + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            for rows, data, offsets in chunks(batch, "text"):
                part = runs.slice(rows.start, rows.stop - rows.start)
                counts = np.diff(part.offsets.to_numpy())
                inner = part.flatten()
                row = np.repeat(np.arange(len(counts)), counts)
                start = inner.field("start").to_numpy() + offsets[row]
                n, names = inner.field("n").to_numpy().astype(np.int64), Names(data)
                anchor = _anchors(names, start, length)
                # Blocks end where the distance to the anchor is a multiple of their size.
                lead = (anchor - start) % block + 1
                pieces = 1 + np.maximum(n - lead + block - 1, 0) // block
                which = np.repeat(np.arange(len(start)), pieces)
                k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = start[which] + np.where(k > 0, lead[which] + (k - 1) * block, 0)
                last = np.minimum(start[which] + lead[which] + k * block, start[which] + n[which]) - 1
                # The core is that of the whole block, of which a run may hold a part.
                end = start[which] + lead[which] + k * block - 1
                distance = (anchor[which] - end).astype(np.uint64)
                key = mix(names.at(end, core) + distance * _ODD[4]) if core < length else names.at(first, core)
                whole = names.at(first, length) * _ODD[2] + names.at(last, length) * _ODD[3]
                full = mix(whole + ((end - first) << 8 | (last - first)).astype(np.uint64))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows][row[which]]
                yield _batch(key, full, ids, first - offsets[row[which]], last - first + 1)

    return run


def _anchors(names: Names, start: np.ndarray, length: int, core: int = 32) -> np.ndarray:
    name = names.power(core.bit_length() - 1)
    order = (name * np.uint64(0xFF51AFD7ED558CCD)) & ~_PLACE | np.arange(len(name), dtype=np.uint64)
    return (_sliding_min(order, length - core + 1)[start] & _PLACE).astype(np.int64)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by id, the first of each id."""
    last = None
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        if len(ids):
            new = np.r_[last is None or ids[0] != last, ids[1:] != ids[:-1]]
            last = ids[-1]
            yield batch.filter(pa.array(new))


def _texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) as a table bucketed by id: the texts are shuffled once, later joins by id move only the other side.

    Rows without id are left out; of rows that repeat an id the one with the smallest text stays. The table lies in the
    shared folder; its size is that of the texts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where(
        "doc_id is not null"
    )
    rows = rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_first_rows, "doc_id long, text string")
    return bucketed(rows, "doc_id", shuffled=True)


def _ranked(runs: DataFrame) -> DataFrame:
    rows = runs.repartition("key").sortWithinPartitions("key", "full", "doc_id", "start")
    return cut_lineage(rows.mapInArrow(_rank, "doc_id long, start long, n int, check boolean"), "ranks")


def repeated_windows(texts: DataFrame, *, length: int = LENGTH, cores: tuple[int, ...] = (32, 93, 100)) -> DataFrame:
    """(doc_id, start, n): runs of n places whose substrings of ``length`` bytes also start earlier.

    Prefix doubling on a sample of places. Ranks of 1, 2, 4, ... 32 bytes are built inside a text; every substring of
    ``length`` bytes then has an anchor, the place of its least 32-byte rank, and the substrings of an anchor form one row. Spark sorts
    rows by (rank of the core, rank of all they cover, place): what repeats the row before is a repetition, what has its core for
    itself is unique, and only the rest is ranked again by cores of growing length, up to the threshold.
    """
    found = None
    for step, core in enumerate(cores):
        if step == 0:
            runs = texts.mapInArrow(_sample(length, core), RUN)
        else:
            open_ = ranks.where("check").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
            runs = texts.join(open_, "doc_id").select("doc_id", "text", "runs").mapInArrow(_closer(length, core), RUN)
        ranks = _ranked(runs)
        done = ranks.where("not check").select("doc_id", "start", "n")
        found = done if found is None else found.unionByName(done)
    return found


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            runs = batch.column("runs")
            for rows, data, offsets in chunks(batch, "text"):
                kept, spans = [], []
                for k in range(len(offsets) - 1):
                    text, cuts = data[offsets[k] : offsets[k + 1]], []
                    some = runs[rows.start + k].values
                    if some is not None and len(some):
                        start, n = some.field("start").to_numpy(), some.field("n").to_numpy()
                        step = np.zeros(len(text) + 1, np.int32)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + n - 1 + length, -1)
                        gone = np.cumsum(step[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                        cuts = [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]
                        text = text[~gone]
                    kept.append(text.tobytes())
                    spans.append(cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, len(kept)), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return run


def deduplicate(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, in order, apart), kept (the other bytes) of every document.

    A byte goes if a substring of ``length`` bytes that covers it also starts earlier: in a smaller
    id, or before in the same text. Texts are UTF-8 bytes, cuts may fall inside a character. A null text is empty; a text shorter than
    ``length`` is kept; rows without id are left out; of rows that repeat an id the smallest text counts; other columns are ignored.
    """
    texts = _texts(docs, id_column=id_column, text_column=text_column)
    runs = repeated_windows(texts, length=length, cores=(32, length - 7, length)).groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "n")).alias("runs")
    )
    return texts.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    )
