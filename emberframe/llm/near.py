"""MinHash near-duplicates by an LSH forest: sorted signature orders, prefix neighbours, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.text import chunks, shingles, words
from emberframe.operators.graph import connected_components, current_labels, extend_components
from emberframe.operators.skew import salted_join
from emberframe.session import cut_lineage

HASHES = 128  # values of a signature
TREES = 48  # signature orders
DEPTH = 8  # values of an order
FLOOR = 3  # values that neighbours share at least
REACH = 6  # neighbours on each side in an order
BEST = 3  # most similar partners of a set that are confirmed first
CROWDED = 7  # orders in which a set must be crowded to be looked up by its shingles as well
SALTS = 4  # places that rows of one key are dealt to
VISITORS = 1000  # texts that one copy of another is held against
SLACK = 4.5  # standard deviations that the estimate may fall below the threshold

_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDERS = np.array([_RNG.permutation(HASHES)[:DEPTH] for _ in range(TREES)])
SKETCH = "doc_id long, n_shingles long, mark1 long, mark2 long, signature binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a chunk, sorted within the row, and where each row starts."""
    hashed, row, _, _ = words(data, offsets)
    value, where, _ = shingles(hashed, row)
    bounds = np.searchsorted(where, np.arange(len(offsets)))
    sets = [np.unique(value[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    starts = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
    return (np.concatenate(sets) if sets else value), starts


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for rows, data, offsets in chunks(batch, "text"):
            value, starts = shingle_sets(data, offsets)
            full = np.flatnonzero(np.diff(starts))
            n, marks = np.diff(starts), np.zeros((2, len(starts) - 1), np.uint64)
            signature = np.zeros((len(full), HASHES), np.uint16)
            if len(full):
                at, short = starts[full], (value >> np.uint64(32)).astype(np.uint32)
                for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    scrambled = (value ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
                    marks[k, full] = np.add.reduceat(scrambled ^ (scrambled >> np.uint64(32)), at)
                for k in range(HASHES):
                    low = np.minimum.reduceat((short ^ _FLIP[k]) * _ODD[k], at)
                    signature[:, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
            held = np.full(len(n), None, dtype=object)
            for k, row in enumerate(full.tolist()):
                held[row] = signature[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(rows.start, len(n)), pa.array(n), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)),
                 pa.array(held, pa.binary())],
                names=["doc_id", "n_shingles", "mark1", "mark2", "signature"],
            )


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and order: its first values (head), the order's values as two sortable longs, and one bit of each value."""
    for batch in batches:
        for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            values = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES).astype(np.uint64)
            weight = np.uint64(1) << np.arange(HASHES // 2, dtype=np.uint64)
            bits = [((values[:, k : k + HASHES // 2] & np.uint64(1)) * weight).sum(axis=1).view(np.int64) for k in (0, HASHES // 2)]
            for tree, order in enumerate(_ORDERS):
                levels = values[:, order]
                packed = [sum(levels[:, s + k] << np.uint64(48 - 16 * k) for k in range(4)).view(np.int64) for s in (0, 4)]
                head = ((packed[0].view(np.uint64) >> np.uint64(16)) + np.uint64((tree + 1) << 48)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(head.view(np.int64)), pa.array(packed[0]), pa.array(packed[1]), part.column("doc_id"),
                     part.column("n_shingles"), pa.array(bits[0]), pa.array(bits[1])],
                    names=["head", "high", "low", "doc_id", "n", "bits1", "bits2"],
                )


def _neighbours(similarity: float):
    """Pairs of rows at most REACH apart in an order that share its first FLOOR values and may be similar enough.

    Rows arrive sorted, so a region with a common prefix deepens by itself: those next to a row share its longest prefixes.
    Where a region goes on beyond the reach, its rows leave once more without a partner, as crowded there.
    """
    agree = (1 + similarity) / 2
    least = HASHES * agree - SLACK * np.sqrt(HASHES * agree * (1 - agree))
    reach = REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("head", "doc_id", "n", "bits1", "bits2")])
            rows = new if held is None else np.concatenate([held, new], axis=1)
            fresh = 0 if held is None else held.shape[1]
            out = []
            for k in range(1, reach + 2):
                one, other = rows[:, :-k], rows[:, k:]
                ok = (one[0] == other[0]) & (one[1] != other[1]) & (np.arange(k, k + one.shape[1]) >= fresh)
                if k > reach:
                    crowded = np.unique(np.concatenate([one[:2, ok], other[:2, ok]], axis=1), axis=1)
                    break
                small, large = np.minimum(one[2], other[2]), np.maximum(one[2], other[2])
                ok &= small >= similarity * large
                at = np.flatnonzero(ok)
                same = HASHES - np.bitwise_count((one[3:, at] ^ other[3:, at]).view(np.uint64)).sum(axis=0, dtype=np.int64)
                at, same = at[same >= least], same[same >= least]
                out.append((np.minimum(one[1, at], other[1, at]), np.maximum(one[1, at], other[1, at]), same))
            held = rows[:, -(reach + 1) :]
            a, b, same = (np.concatenate(x) for x in zip(*out))
            names = ["a", "b", "same", "head"]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(same), pa.nulls(len(a), pa.int64())], names=names)
            if crowded.shape[1]:
                none = pa.nulls(crowded.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(crowded[1]), none, none, pa.array(crowded[0])], names=names)

    return run


def _compare(percent: int):
    """Rows sorted by key, the key's own document first: every visitor is held against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, own = None, None
        for batch in batches:
            keys, visits, ids = (batch.column(c).to_pylist() for c in ("key", "visit", "doc_id"))
            found = []
            for rows, data, offsets in chunks(batch, "text"):
                value, starts = shingle_sets(data, offsets)
                for k, row in enumerate(range(rows.start, rows.stop)):
                    mine = value[starts[k] : starts[k + 1]]
                    if not visits[row]:
                        owner, own = keys[row], mine.copy()
                    elif owner == keys[row]:
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(mine) - both):
                            found.append((owner, ids[row]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return run


def meet(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (key, salt, visit, doc_id, text) sorted so that the text of ``a`` comes first, then those of all its ``b``.

    Texts travel, not sets: they compress better. One text waits in memory while the others stream past it, however many
    there are; one with many visitors is dealt out with a copy per VISITORS of them.
    """
    load = pairs.groupBy(F.col("a").alias("owner")).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("copies"))
    owners = load.select(
        F.col("owner").alias("doc_id"), F.col("owner").alias("key"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"),
        F.lit(0).alias("visit"),
    )
    visitors = pairs.join(load, F.col("a") == F.col("owner")).select(
        F.col("b").alias("doc_id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"),
        F.lit(1).alias("visit"),
    )
    # Merged at every size: a small list of pairs would otherwise be broadcast and the plan change as tables grow.
    met = docs.hint("merge").join(owners.unionByName(visitors), "doc_id").select("key", "salt", "visit", "doc_id", "text")
    return met.repartition("key", "salt").sortWithinPartitions("key", "salt", "visit", "doc_id")


def confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough, as (u, v)."""
    return meet(docs, pairs).mapInArrow(_compare(percent), "u long, v long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and distinct shingle. Rows are sorted by document; one that repeats an id adds nothing."""
    last = None
    for batch in batches:
        ids, groups = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component"))
        for rows, data, offsets in chunks(batch, "text"):
            value, starts = shingle_sets(data, offsets)
            doc, n = ids[rows], np.diff(starts)
            new = np.r_[doc[:1] != last if last is not None else True, doc[1:] != doc[:-1]]
            times, last = np.where(new, n, 0), int(doc[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[np.repeat(new, n)].view(np.int64)), *(pa.array(np.repeat(x, times)) for x in (doc, groups[rows], n))],
                names=["shingle", "doc_id", "component", "n"],
            )


def crowded_sets(met: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, component: sets whose partners the forest may have passed by.

    Those are the sets that have more neighbours than the reach, in CROWDED orders or more, in regions that still hold several components.
    A pair at the threshold shares the first values of about 20 of the 48 orders (of fewer than 7 with a probability of
    1e-5), and is passed by only if it is out of reach in every one of them.
    """
    known = labels.select(F.col("id").alias("doc_id"), F.col("super_id").alias("component"))
    crowd = met.where("b is null").select("head", F.col("a").alias("doc_id")).distinct().join(known, "doc_id", "left")
    crowd = cut_lineage(crowd.withColumn("component", F.coalesce("component", "doc_id")), "crowded")
    mixed = crowd.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("head")
    inside = salted_join(crowd, mixed, ["head"], F.col("doc_id"), salts=SALTS)
    return inside.groupBy("doc_id").agg(F.min("component").alias("component"), F.count("*").alias("orders")).where(
        F.col("orders") >= CROWDED
    ).drop("orders")


def prefix_pairs(whole: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` in different components that may reach ``percent``: none that does is missing.

    Shingles that one component alone has come first in the common order, the others by the number of sets that hold them.
    Two sets that are similar enough have their first common shingle in the first quarter of the larger one and the first seventh of
    the smaller one (at 75), with enough shingles after it in both. The shingles of a template that all have stand at the end,
    so a large group of middling similarity meets by its rare shingles only. The size of the partner that
    a place in the order allows for is part of the key.
    """
    p = F.lit(percent)
    texts = whole.hint("merge").join(sets, "doc_id").select("doc_id", "component", "text").sortWithinPartitions("doc_id")
    postings = cut_lineage(texts.mapInArrow(_postings, "shingle long, doc_id long, component long, n long"), "postings")
    shared = postings.groupBy("shingle").agg(
        F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo < hi").select("shingle", "f")
    mine = salted_join(postings, shared, ["shingle"], F.col("doc_id"), salts=SALTS)
    order = Window.partitionBy("doc_id").orderBy(F.desc("f"), F.desc("shingle"))
    ranked = mine.withColumn("left", F.row_number().over(order).cast("long"))  # this shingle and those after it
    prefixes = cut_lineage(ranked.where(F.col("left") * 100 >= p * F.col("n")).drop("f"), "prefixes")
    size = lambda n: F.floor(F.log(n) * 10).cast("int")
    least, most = F.ceil(p * F.col("n") / 100), F.least(F.col("n"), F.floor(F.col("left") * (100 + p) / p) - F.col("n"))
    probes = prefixes.where(least <= most).withColumn("size", F.explode(F.sequence(size(least), size(most))))
    index = prefixes.where(F.col("left") * (100 + p) >= 2 * p * F.col("n")).select(
        "shingle", size(F.col("n")).alias("size"), F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"),
        F.col("left").alias("lb"),
    )
    met = salted_join(probes, index, ["shingle", "size"], F.col("doc_id"), salts=SALTS).where(
        (F.col("component") != F.col("cb")) & ((F.col("nb") < F.col("n")) | ((F.col("nb") == F.col("n")) & (F.col("b") < F.col("doc_id"))))
        & (100 * F.col("nb") >= p * F.col("n")) & ((100 + p) * F.least("left", "lb") >= p * (F.col("n") + F.col("nb")))
    )
    return met.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose shingle sets have a Jaccard similarity of percent / 100.

    1. One pass makes a signature per document; equal sets (128-bit marks of the whole set) collapse to their smallest id.
    2. Every set stands in 48 sorted orders of its signature. Sets that share the first 3 values of an order and
       stand at most 6 places apart are candidates. A crowded region deepens: sorting puts the longest common
       prefixes next to each other.
    3. Candidates are confirmed on whole sets, first each set's three most similar partners; after that only
       pairs that those links leave in different components, since others cannot change a component.
    4. Sets of regions too crowded for the reach, where these still hold several components, meet by an exact
       prefix join on their shingles, so that no link is lost there; its pairs are confirmed in the same way.

    A text with fewer than five words is one shingle; a null, empty or blank text has none and stands alone. A row without id
    takes no part. Rows that repeat an id and its text give one result. Other columns are ignored.
    """
    whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    sketches = cut_lineage(whole.mapInArrow(_sketch, SKETCH), "sketches")
    some = sketches.where("n_shingles > 0")
    classes = some.groupBy("mark1", "mark2").agg(F.min("doc_id").alias("rep"))
    members = some.select("doc_id", "n_shingles", "mark1", "mark2")
    members = cut_lineage(salted_join(members, classes, ["mark1", "mark2"], F.col("doc_id"), salts=SALTS), "members")
    copies = members.where("doc_id <> rep").select("doc_id", "mark1", "mark2").distinct()
    reps = some.join(copies, ["doc_id", "mark1", "mark2"], "left_anti").select("doc_id", "n_shingles", "signature")
    orders = reps.mapInArrow(_forest, "head long, high long, low long, doc_id long, n long, bits1 long, bits2 long")
    near = orders.repartition("head").sortWithinPartitions("head", "high", "low", "doc_id").mapInArrow(
        _neighbours(percent / 100), "a long, b long, same long, head long"
    )
    met = cut_lineage(near, "neighbours")
    pairs = cut_lineage(met.where("b is not null").groupBy("a", "b").agg(F.max("same").alias("same")), "candidates")

    both = pairs.select(F.col("a").alias("x"), "b", "a", "same").unionByName(pairs.select(F.col("b").alias("x"), "b", "a", "same"))
    order = Window.partitionBy("x").orderBy(F.desc("same"), "a", "b")  # at most 2 * TREES * REACH rows
    best = cut_lineage(both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= BEST).select("a", "b").distinct(), "best")
    first = cut_lineage(confirm(whole, best, percent), "links")
    joined = _labels(pairs, first)
    open_pairs = (
        pairs.join(joined.select(F.col("id").alias("a"), F.col("super_id").alias("ca")), "a")
        .join(joined.select(F.col("id").alias("b"), F.col("super_id").alias("cb")), "b")
        .where("ca <> cb").select("a", "b")
    )
    rest = cut_lineage(open_pairs.join(best, ["a", "b"], "left_anti"), "open")
    second = cut_lineage(confirm(whole, rest, percent), "links")
    found = _labels(pairs, first.unionByName(second))
    tied = cut_lineage(prefix_pairs(whole, cut_lineage(crowded_sets(met, found), "tied"), percent), "candidates")
    third = cut_lineage(confirm(whole, tied, percent), "links")
    final = current_labels(found.unionByName(extend_components(found, third.select(F.col("u").alias("id")), third, salts=2)))
    of_rep = final.withColumnRenamed("id", "rep")
    labelled = salted_join(members, of_rep, ["rep"], F.col("doc_id"), "left", SALTS).select(
        "doc_id", "n_shingles", F.coalesce("super_id", "rep").alias("component_id")
    )
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.unionByName(alone).groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _labels(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Component of every document in a pair, written to the shared folder."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    return cut_lineage(connected_components(ends, links, salts=2), "components")
