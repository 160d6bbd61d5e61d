"""Near-duplicate passages by compact windows: Cartesian trees over min-hashes of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.near import VISITORS
from emberframe.llm.substrings import _sliding_min
from emberframe.llm.text import SHINGLE_WORDS, _powers, chunks, mix, shingles, words
from emberframe.operators.skew import salted_join
from emberframe.session import cut_lineage

WORDS = 50  # least length of a passage
HASHES = 4
DRIFT = 6  # words by which a passage may shift against its source
FEW = 3  # windows of a signature that are linked all with all at once
BLOCK = 1024  # neighbourhoods of a signature that one task compares with as many others
ROW = "key long, doc_id long, l int, r int, other long, ol int, orr int, c int"
LINK = "a long, b long, al int, ar int, bl int, br int"
_SALTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def compact_windows(value: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees over ``value`` of each row: the nodes whose span holds at least ``width`` places.

    Every range [i, j] with l <= i <= c <= j <= r has its least value, the first if several are equal, at c. A node is wide
    enough exactly if some range of ``width`` places has its minimum there, and so are its ancestors, which is why
    the nodes' bounds, the nearest smaller values on both sides, can be found among the nodes alone.
    """
    n = len(value)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    place = np.uint64((1 << 31) - 1)
    order = value & ~place | np.arange(n, dtype=np.uint64)
    least = (_sliding_min(order, width) & place).astype(np.int64)
    least = least[row[: n - width + 1] == row[width - 1 :]]
    if not len(least):
        return none, none, none
    c = least[np.r_[True, least[1:] != least[:-1]]]  # the place of the least value never goes back
    m = len(c)
    # One more node, which both ends point to, belongs to no row.
    v, doc = np.r_[order[c], np.uint64(0)], np.r_[row[c], -1]
    left, right = np.arange(m) - 1, np.arange(m) + 1
    for bound, way in ((left, 1), (right, -1)):
        on = np.arange(m)
        while len(on) > 16:  # only nodes whose bound still moves are looked at again
            at = bound[on]
            on = on[(doc[at] == doc[on]) & (v[at] > v[on])]
            bound[on] = bound[bound[on]]
        for k in on[::way].tolist():  # a few may have a long way to go
            at, mine = bound[k], v[k]
            while doc[at] == doc[k] and v[at] > mine:
                at = bound[at]
            bound[k] = at
    starts = np.searchsorted(row, doc[:m], side="left")
    ends = np.searchsorted(row, doc[:m], side="right") - 1
    place = np.r_[c, 0]
    return np.where(doc[left] == doc[:m], place[left] + 1, starts), c, np.where(doc[right] == doc[:m], place[right] - 1, ends)


def _least_beside(value: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    return _sliding_min(value, n) if 0 < n <= len(value) else np.zeros(0, np.uint64)


def _signatures(key: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, beside: list[np.ndarray], width: int):
    """(c, l, r, signature): each window once per side of c on which a passage must go on.

    A passage of ``width`` shingles whose least value stands at c holds the ``width // 2`` shingles before c or the rest of the
    ``width`` after it. The least value of a second function over that side joins the signature, so that windows that have no
    more than a frequent line in common mostly part here.
    """
    before = width // 2
    after = width - 1 - before
    left, right = np.flatnonzero(c - l >= before), np.flatnonzero(r - c >= after)
    sides = [mix(beside[0][c[left] - before] + _SALTS[-2]) if before else np.zeros(len(left), np.uint64),
             mix(beside[1][c[right] + 1] + _SALTS[-3]) if after else np.zeros(len(right), np.uint64)]
    at = np.r_[left, right]
    return c[at], l[at], r[at], mix(key[at] ^ np.concatenate(sides))


def _rows(key, doc, l, r, other=None, ol=None, orr=None, c=None) -> pa.RecordBatch:
    n = len(key)
    ints = [pa.nulls(n, pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (l, r, ol, orr, c)]
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc), ints[0], ints[1],
         pa.nulls(n, pa.int64()) if other is None else pa.array(other),
         *ints[2:]],
        names=["key", "doc_id", "l", "r", "other", "ol", "orr", "c"],
    )


def _windows(width: int):
    """Compact windows of a chunk by signature: for each document the range from its first window of the signature to its last.

    A range leaves as a link to an earlier document of the chunk, instead of under the signature, only if it has the
    same shingles in the same order there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, data, offsets in chunks(batch, "text"):
                hashed, word_row, _, _ = words(data, offsets)
                value, row, _ = shingles(hashed, word_row)
                if not len(value):
                    continue
                base = np.searchsorted(row, np.arange(len(offsets) - 1))
                beside = [_least_beside(mix(value ^ _SALTS[-1]), n) for n in (width // 2, width - 1 - width // 2)]
                up, down = _powers(len(value))
                total = np.r_[np.zeros(1, np.uint64), np.cumsum(value * up)]
                for salt in _SALTS[:HASHES]:
                    own = mix(value ^ salt)
                    l, c, r = compact_windows(own, row, width)
                    if not len(c):
                        continue
                    c, l, r, key = _signatures(own[c] + salt, l, c, r, beside, width)
                    where = row[c]
                    order = np.lexsort((l, where, key))
                    key, where, l, r, c = key[order], where[order], l[order], r[order], c[order]
                    head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (where[1:] != where[:-1])])
                    several = np.diff(np.r_[head, len(key)]) > 1
                    key, where, l, r, c = key[head], where[head], l[head], np.maximum.reduceat(r, head), c[head]
                    content = mix((total[r + 1] - total[l]) * down[l] + (r - l).astype(np.uint64))
                    doc, l, r, c = ids[rows][where], l - base[where], r - base[where], c - base[where]
                    c = np.where(several, ~c, c)
                    order = np.lexsort((l, doc, content, key))
                    key, content, doc, l, r, c = key[order], content[order], doc[order], l[order], r[order], c[order]
                    head = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])]
                    lead = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
                    away = doc != doc[lead]
                    yield _rows(key[~away], doc[~away], l[~away], r[~away], c=c[~away])
                    link = np.flatnonzero(away)
                    if len(link):
                        to = lead[link]
                        free = mix(doc[link].astype(np.uint64) * salt + l[link].astype(np.uint64))
                        yield _rows(free, doc[link], l[link], r[link], doc[to], l[to], r[to])

    return run


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc_id, l): up to FEW windows of a signature are linked all with all, those of others leave with key and place."""
    names = ("key", "doc_id", "l", "r", "c")
    rows, open_key = np.zeros((5, 0), np.int64), None
    for batch in chain(batches, [None]):
        if batch is not None:
            done = batch.filter(pc.is_valid(batch.column("other")))
            if done.num_rows:
                n = done.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(done.column(x) for x in ("other", "doc_id", "ol", "orr", "l", "r")), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
                    names=["a", "b", "al", "ar", "bl", "br", "key", "c"],
                )
            rest = batch.filter(pc.is_null(batch.column("other")))
            rows = np.concatenate([rows, np.stack([rest.column(x).to_numpy().astype(np.int64) for x in names])], axis=1)
        n = rows.shape[1]
        if not n:
            continue
        heads = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        which = np.searchsorted(heads, np.arange(n), side="right") - 1
        many = np.diff(np.r_[heads, n])[which] > FEW
        if open_key is not None:
            many |= rows[0] == open_key
        waits = ~many & (which == which[-1]) & (batch is not None)  # the last signature may go on
        at = [np.flatnonzero((which[k:] == which[:-k]) & ~many[k:] & ~waits[k:] & (rows[1, k:] != rows[1, :-k])) for k in range(1, min(FEW, n))]
        one, other = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *(x + k for k, x in enumerate(at, 1))])
        m, crowd = len(one), rows[:, many]
        if m:
            small = [pa.array(rows[k, x].astype(np.int32)) for x in (one, other) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[1, one]), pa.array(rows[1, other]), *small, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())],
                names=["a", "b", "al", "ar", "bl", "br", "key", "c"],
            )
        if crowd.shape[1]:
            none, small = pa.nulls(crowd.shape[1], pa.int32()), [pa.array(crowd[k].astype(np.int32)) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(crowd[1]), pa.nulls(crowd.shape[1], pa.int64()), small[0], small[1], none, none, pa.array(crowd[0]), small[2]],
                names=["a", "b", "al", "ar", "bl", "br", "key", "c"],
            )
        open_key, rows = (rows[0, -1] if many[-1] else None), rows[:, waits]


def _surroundings(width: int):
    """Of each window the shingles around its least one, as 32 bits, 0 beyond the window; once for equal ones of a document and signature.

    ``width`` - 1 places on each side hold every passage of ``width`` shingles through the least one; its counterpart may lie 2 * DRIFT further.
    A window that stands for several of its signature (c is negative) is cut into pieces of that size, each ``width`` after the last, so that every
    passage lies in one; pieces without the least shingle drop out.
    """
    reach = width - 1 + 2 * DRIFT
    near = np.arange(-reach, reach + 1)
    weight = mix(np.arange(1, len(near) + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column("doc_id").to_numpy(), batch.column("windows")
            for rows, data, offsets in chunks(batch, "text"):
                hashed, word_row, _, _ = words(data, offsets)
                value, row, _ = shingles(hashed, word_row)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                short = np.maximum(value >> np.uint64(32), np.uint64(1)).astype(np.uint32)
                for k in range(len(offsets) - 1):
                    own, mine, seen = value[bounds[k] : bounds[k + 1]], short[bounds[k] : bounds[k + 1]], set()
                    found = held[rows.start + k].values if held[rows.start + k].is_valid else None
                    if found is None or not len(own):
                        continue
                    key, l, r, c = (found.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("key", "l", "r", "c"))
                    ok = r < len(own)  # a row that repeats the id may be shorter
                    key, l, r, c = key[ok], l[ok], r[ok], c[ok]
                    several, c = c < 0, np.where(c < 0, ~c, c)
                    upto = np.cumsum(np.where(several, np.maximum(r - l + 1, width) // width, 1))
                    for first in range(0, int(upto[-1]) if len(upto) else 0, 4096):
                        step = np.arange(first, min(first + 4096, int(upto[-1])))
                        w = np.searchsorted(upto, step, side="right")
                        at = np.where(several[w], l[w] + (step - np.r_[0, upto][w]) * width + width - 1, c[w])
                        place = at[:, None] + near
                        beyond = (place < l[w][:, None]) | (place > r[w][:, None])
                        token = np.where(beyond, np.uint32(0), mine[place.clip(0, len(mine) - 1)])
                        inside = (token[:, 2 * DRIFT : -2 * DRIFT] == mine[c[w]][:, None]).any(axis=1)
                        w, token = w[inside], token[inside]
                        content = mix((token.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)).view(np.int64)
                        new = []
                        for x, name in enumerate(zip(key[w].tolist(), content.tolist())):
                            if name not in seen:
                                seen.add(name)
                                new.append(x)
                        if new:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(key[w][new]), pa.array(np.full(len(new), ids[rows.start + k])), pa.array(l[w][new].astype(np.int32)),
                                 pa.array(r[w][new].astype(np.int32)), pa.array(content[new]),
                                 pa.array([t.tobytes() for t in token[new]], pa.binary())],
                                names=["key", "doc_id", "l", "r", "content", "tokens"],
                            )

    return run


def _chosen(doc: np.ndarray, tokens: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """(earlier, later) rows of one signature, sorted by document, that are to be compared.

    A row meets, for each of its stretches of ``width`` shingles, the first earlier one that holds ``least`` of them, and one of each group of such
    earlier ones that no meeting has joined yet: so every stretch meets a source, if the rows hold one, and all that are similar stay connected.
    """
    n, out = len(doc), []
    value, name = np.unique(tokens, return_inverse=True)
    name = name.reshape(tokens.shape)
    if n * len(value) <= 1 << 22:
        times = np.zeros((n, len(value)), bool)
        times[np.arange(n)[:, None], name] = True
        times = times.sum(axis=0)
    else:
        times = np.bincount(np.unique(name * n + np.arange(n)[:, None]) // n, minlength=len(value))  # each shingle once per row
    shared = np.flatnonzero((times > 1) & (value != 0))
    number = np.full(len(value), len(shared))  # the last column stands for all that no other row holds
    number[shared] = np.arange(len(shared))
    has = np.zeros((n, len(shared) + 1), bool)
    has[np.arange(n)[:, None], number[name]] = True
    has[:, -1] = False
    middle = tokens.shape[1] // 2
    inner = number[name[:, middle - width + 1 : middle + width]]

    def held(x: np.ndarray, least: int) -> np.ndarray:
        sums = np.zeros((len(x), x.shape[1] + 1), np.int16)
        np.cumsum(x, axis=1, dtype=np.int16, out=sums[:, 1:])
        return sums[:, width:] - sums[:, :-width] >= least

    whole = held(tokens[:, middle - width + 1 : middle + width] != 0, width)
    may = np.flatnonzero((held(inner < len(shared), least) & whole).any(axis=1))
    may, group = may[may > 0], np.arange(n)
    step = max(1, (1 << 20) // (n * inner.shape[1]))
    for some in (may[x : x + step] for x in range(0, len(may), step)):  # so many later rows at a time against all before them
        upto = some[-1]
        met = has[:upto].take(inner[some], axis=1)
        hit = (np.count_nonzero(met, axis=2) >= least) & (np.arange(upto)[:, None] < some) & (doc[:upto, None] != doc[some])
        which, earlier = np.nonzero(hit.T)
        covered = held(met[earlier, which], least) & whole[some[which]]
        near = covered.any(axis=1)
        all_of_it = covered.sum(axis=1) == whole[some].sum(axis=1)[which]
        bounds = np.searchsorted(which, np.arange(len(some) + 1)).tolist()
        for k, x, y in zip(some.tolist(), bounds, bounds[1:]):
            if x == y:
                continue
            of = group[earlier[x:y]]
            if all_of_it[x] and (of == of[0]).all():  # the first has all
                out.append((int(earlier[x]), k))
                group[k] = of[0]
                continue
            before, covers, of = earlier[x:y][near[x:y]], covered[x:y][near[x:y]], of[near[x:y]]
            if not len(before):
                continue
            first = np.zeros(len(before), bool)
            first[covers.argmax(axis=0)[covers.any(axis=0)]] = True
            if (of == of[0]).all():
                group[k] = of[0]
            else:
                joined, lead = np.zeros(n, bool), np.zeros(n, np.int64)
                joined[of[first]] = True
                lead[of[::-1]] = np.arange(len(of))[::-1]  # the first of each group
                first[lead[of[~joined[of]]]] = True
                joined[of] = True
                group[:k][joined[group[:k]]] = k
                group[k] = k
            out += [(j, k) for j in before[first].tolist()]
    return out


_PLACE = ("doc_id", "l", "r")


def _links(one: list, other: list) -> pa.RecordBatch:
    """Links of (doc_id, l, r) in ``one`` and in ``other``, the smaller document first."""
    small, large = zip(*((x, y) if x[0] < y[0] else (y, x) for x, y in zip(one, other)))
    (a, al, ar), (b, bl, br) = zip(*small), zip(*large)
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(x, pa.int32()) for x in (al, ar, bl, br))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "al", "ar", "bl", "br"])


def _met(rows: list, width: int, least: int, across: bool = False) -> list[tuple[tuple, tuple]]:
    """Pairs of places among rows (doc_id, l, r, tokens, part) of one signature; with ``across`` those of different parts only."""
    rows = sorted(rows, key=lambda x: x[:3])
    tokens = np.frombuffer(b"".join(x[3] for x in rows), np.uint32).reshape(len(rows), -1)
    found = _chosen(np.array([x[0] for x in rows], np.int64), tokens, width, least)
    return [(rows[x][:3], rows[y][:3]) for x, y in found if not across or rows[x][4] != rows[y][4]]


def _meet_signature(width: int, least: int):
    """Rows sorted by (key, content, doc_id): equal surroundings are linked with their first, which meet at the end of the signature.

    The first ones of a signature that has more than BLOCK of them leave with their key and shingles instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = content = first = None
        rows, large = [], False
        names = ["a", "b", "al", "ar", "bl", "br", "key", "tokens"]

        def linked(found):
            batch, n = _links(*zip(*found)), len(found)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

        def parted(key, rows):
            doc, l, r, tokens, _ = zip(*rows)
            none = pa.nulls(len(rows), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(l, pa.int32()), pa.array(r, pa.int32()), none, none,
                 pa.array([key] * len(rows), pa.int64()), pa.array(tokens, pa.binary())], names=names,
            )

        for batch in chain(batches, [None]):
            found = []
            columns = [batch.column(x).to_pylist() for x in ("key", "content", *_PLACE, "tokens")] if batch is not None else [[None]] * 6
            for k, c, doc, l, r, tokens in zip(*columns):
                if k != key:
                    if large and rows:
                        yield parted(key, rows)
                    elif len(rows) > 1:
                        found += _met(rows, width, least)
                    key, content, rows, large = k, None, [], False
                if k is None:  # the end
                    break
                if c == content:
                    if doc != first[0]:
                        found.append((first, (doc, l, r)))
                    continue
                content, first = c, (doc, l, r)
                rows.append((doc, l, r, tokens, 0))
                if len(rows) > BLOCK:
                    yield parted(key, rows)
                    rows, large = [], True
            if found:
                yield linked(found)

    return run


def _meet_blocks(width: int, least: int):
    """Rows sorted by (key, i, j): the rows of blocks i and j of a signature, those of one block among themselves if i is j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in chain(batches, [None]):
            found = []
            columns = [batch.column(x).to_pylist() for x in ("key", "i", "j", *_PLACE, "tokens", "block")] if batch is not None else [[None]] * 8
            for k, i, j, *row in zip(*columns):
                if (k, i, j) != name:
                    if len(rows) > 1:
                        found += _met(rows, width, least, name[1] != name[2])
                    name, rows = (k, i, j), []
                if k is None:  # the end
                    break
                rows.append(tuple(row))
            if found:
                yield _links(*zip(*found))

    return run


def _crowded_links(docs: DataFrame, crowd: DataFrame, width: int, least: int) -> DataFrame:
    """Links among the windows (key, doc_id, l, r, c) of signatures that many have: the shingles around the least one decide who meets.

    A signature is compared in one task up to BLOCK different surroundings, beyond that in a task for each two of its blocks.
    """
    of_doc = crowd.groupBy("doc_id").agg(F.collect_list(F.struct("key", "l", "r", "c")).alias("windows"))
    around = docs.hint("merge").join(of_doc, "doc_id").select("doc_id", "windows", "text").mapInArrow(
        _surroundings(width), "key long, doc_id long, l int, r int, content long, tokens binary"
    )
    met = cut_lineage(around.repartition("key").sortWithinPartitions("key", "content", "doc_id").mapInArrow(
        _meet_signature(width, least), f"{LINK}, key long, tokens binary"
    ), "crowded")
    large = met.where("b is null").select("key", F.col("a").alias("doc_id"), F.col("al").alias("l"), F.col("ar").alias("r"), "tokens")
    load = large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = salted_join(large, load, ["key"], F.col("doc_id")).withColumn("block", F.pmod(F.xxhash64("doc_id", "l"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "doc_id", "l", "r", "tokens", "block"
    )
    across = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_meet_blocks(width, least), LINK)
    return met.where("b is not null").drop("key", "tokens").unionByName(across)


def matches(one: np.ndarray, other: np.ndarray, width: int, least: int) -> list[tuple[int, int, int]]:
    """(start in ``other``, length, start in ``one``) of the stretches of ``other`` all of whose ``width`` consecutive shingles have at
    least ``least`` in the same stretch of ``one``, in shingles. A shingle may recur: any of its places in ``one`` counts."""
    m = len(one)
    if len(other) < width or m < width:
        return []
    order = np.argsort(one, kind="stable")
    ordered = one[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    low = np.searchsorted(ordered, other)
    hit = ordered[np.minimum(low, m - 1)] == other
    runs = np.diff(heads, append=m)
    times = np.where(hit, np.repeat(runs, runs)[np.minimum(low, m - 1)], 0)
    high, places, out = low + times, None, []

    def windows(ok: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(ok) + 1, np.int32)
        np.cumsum(ok, out=sums[1:])
        return sums[width:] - sums[:-width] >= least

    for a, b in _stretches(windows(hit)):
        lo, hi = low[a : b + width - 1], high[a : b + width - 1]
        n = len(lo)
        main = _only_shift(order, lo, times[a : b + width - 1])
        if main is not None and -DRIFT <= main <= m - n + DRIFT:
            out.append((a, n, max(0, main)))
            continue
        if places is None:
            places = np.repeat(heads, runs) * (m + 1) + order  # ascending: by value, then by place
        missing = np.ones(b - a, bool)
        # A stretch may have several sources; shifts are looked at until every window of it has one.
        for main in _main_shifts(order, lo, hi, least):
            s, e = max(0, -main - DRIFT), min(n, m - main + DRIFT)
            if e - s < width or not missing[s : e - width + 1].any():
                continue
            target, x, y = np.arange(s, e) + main, lo[s:e], hi[s:e]
            last = np.minimum(np.maximum(y - 1, x), m - 1)
            k = np.searchsorted(places, x * (m + 1) + np.minimum(np.maximum(target, 0), m))
            gap = [np.abs(order[np.minimum(np.maximum(z, x), last)] - target) for z in (k - 1, k)]
            close = (y > x) & (np.minimum(*gap) <= DRIFT)
            for x, y in _stretches(windows(close)):
                if missing[s + x : s + y].any():
                    out.append((a + s + x, y - x + width - 1, max(0, s + x + main)))
                    missing[s + x : s + y] = False
            if not missing.any():
                break
    return out


def _shift_order(shift: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The most frequent shifts first; equal counts in scattered order, as neighbours of a long run would each add a few places only."""
    return np.lexsort((mix(shift.astype(np.uint64)), -count))


def _only_shift(order: np.ndarray, lo: np.ndarray, times: np.ndarray) -> int | None:
    """The first of the main shifts of a stretch without recurring shingles whose shifts all lie within DRIFT of each other."""
    if times.max() > 1:
        return None
    at = np.flatnonzero(times)
    shift = order[lo[at]] - at
    least = int(shift.min())
    if shift.max() - least > DRIFT:
        return None
    count = np.bincount(shift - least)
    found = np.flatnonzero(count)
    # As in _main_shifts, shifts are numbered from 1 - len(lo).
    return least + int(found[_shift_order(found + least + len(lo) - 1, count[found])[0]])


def _main_shifts(order: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> Iterator[int]:
    """Shifts by which many places order[lo:hi] lie behind their shingle, the most frequent first, if ``least`` pairs are within DRIFT of it."""
    m, n = len(order), len(lo)
    count, times = np.zeros(m + n, np.int64), hi - lo
    heavy = np.zeros(n, bool)
    if times.max() * n > 16 * (m + n):
        _, which, visits = np.unique(lo, return_inverse=True, return_counts=True)
        heavy = visits[which] * times > 16 * (m + n)
    size = 1 << int(m + n).bit_length()
    for v in np.unique(lo[heavy]).tolist():  # all pairs of a value at once, as a convolution
        here = np.flatnonzero(heavy & (lo == v))
        x, y = np.zeros(m), np.zeros(n)
        x[order[lo[here[0]] : hi[here[0]]]], y[n - 1 - here] = 1, 1
        count += np.rint(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: m + n]).astype(np.int64)
    rest = np.flatnonzero(~heavy & (times > 0))
    upto = np.cumsum(times[rest])
    while len(rest):
        k = max(1, int(np.searchsorted(upto, 1 << 21)))
        at, upto, rest = rest[:k], upto[k:] - upto[k - 1], rest[k:]
        t = times[at]
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        count += np.bincount(order[np.repeat(lo[at], t) + step] - np.repeat(at, t) + n - 1, minlength=m + n)
    total = np.r_[0, np.cumsum(count)]
    at = np.flatnonzero(count)
    at = at[total[np.minimum(at + DRIFT + 1, m + n)] - total[np.maximum(at - DRIFT, 0)] >= least]
    taken = np.zeros(m + n, bool)
    for k in at[_shift_order(at, count[at])].tolist():
        if not taken[k]:
            taken[max(0, k - DRIFT // 2) : k + DRIFT // 2 + 1] = True
            yield k - n + 1


def _stretches(on: np.ndarray) -> list[tuple[int, int]]:
    padded = np.zeros(len(on) + 2, bool)
    padded[1:-1] = on
    edge = np.flatnonzero(padded[1:] != padded[:-1]).tolist()
    return list(zip(edge[::2], edge[1::2]))


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut to the words of the shingles lo to hi; rows of a document follow each other, so it is split into words once."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        which = np.searchsorted(heads, np.arange(len(ids)), side="right") - 1
        lo, hi, out = batch.column("lo").to_numpy(), batch.column("hi").to_numpy(), []
        for rows, data, offsets in chunks(batch.select(["text"]).take(pa.array(heads)), "text"):
            _, row, start, end = words(data, offsets, lower=False)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            raw = data.tobytes()
            first, last = np.searchsorted(which, [rows.start, rows.stop])
            for at in range(first, last):
                k = which[at] - rows.start
                a, b = bounds[k], bounds[k + 1]
                out.append(raw[start[a + lo[at]] : end[min(b - 1, a + hi[at] + SHINGLE_WORDS - 1)]] if b > a else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("key", "salt", "visit", "doc_id", "lo")] + [pa.array(out, pa.binary())],
            names=["key", "salt", "visit", "doc_id", "lo", "text"],
        )


def _meet(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ranges of each pair's texts, the earlier document's first, then those of all that are held against it.

    Only ranges travel. A document with many others is dealt out with a copy of its range per VISITORS of them.
    """
    load = pairs.groupBy("a").agg(
        F.ceil(F.count("*") / VISITORS).cast("int").alias("copies"), F.min("al").alias("lo"), F.max("ar").alias("hi")
    )
    owners = load.select(
        F.col("a").alias("doc_id"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"),
        F.lit(0).alias("visit"), "lo", "hi",
    )
    visitors = pairs.join(load.select("a", "copies"), "a").select(
        F.col("b").alias("doc_id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"),
        F.lit(1).alias("visit"), F.col("bl").alias("lo"), F.col("br").alias("hi"),
    )
    joined = docs.hint("merge").join(owners.unionByName(visitors), "doc_id").select("key", "salt", "visit", "doc_id", "lo", "hi", "text")
    met = joined.mapInArrow(_trim, "key long, salt int, visit int, doc_id long, lo int, text binary")
    return met.repartition("key", "salt").sortWithinPartitions("key", "salt", "visit", "doc_id", "lo")


def _least(width: int, percent: int) -> int:
    """Shingles that two stretches of ``width`` have in common at a Jaccard similarity of ``percent``."""
    return -(-2 * width * percent // (100 + percent))


def _verify(width: int, percent: int):
    least = _least(width, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, own, base = None, None, 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("key", "visit", "doc_id", "lo")}
            out = []
            for rows, data, offsets in chunks(batch, "text"):
                hashed, row, _, _ = words(data, offsets)
                value, where, _ = shingles(hashed, row)
                bounds = np.searchsorted(where, np.arange(len(offsets)))
                for k, at in enumerate(range(rows.start, rows.stop)):
                    mine = value[bounds[k] : bounds[k + 1]]
                    if not cols["visit"][at]:
                        owner, own, base = cols["key"][at], mine.copy(), cols["lo"][at]
                    elif owner == cols["key"][at]:
                        lo = cols["lo"][at]
                        out += [
                            (cols["doc_id"][at], lo + s, n + SHINGLE_WORDS - 1, owner, base + o) for s, n, o in matches(own, mine, width, least)
                        ]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start_word", "n_words", "source_id", "source_word"]
                )

    return run


def repeated_passages(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", min_words: int = WORDS, percent: int = 75,
) -> DataFrame:
    """doc_id, start_word, n_words, source_id, source_word: passages of a document that an earlier one (smaller id) has too.

    A passage has at least ``min_words`` words; in each stretch of that many, the five-word shingles of both documents have a
    Jaccard similarity of ``percent`` / 100 or more. Words count from 0, letters A-Z are lower-cased.

    Each text gives, per hash function, the compact windows of its shingles: about two per ``min_words`` words. Spark
    sorts them by signature (function and least value); one that stands alone drops out, up to FEW are linked all with all. Of a signature
    that more windows have, the shingles around the least one meet: equal ones are linked with their first; of the others, each
    stretch of a document with the first document that has it. No holder is left untried, though documents that share
    a passage may be linked through others only. The links of a pair of documents are joined into the ranges they span, and these are compared
    shingle by shingle.

    A document may have a passage with several sources, and overlapping passages. Null, empty and short texts have none; rows without id take
    no part; rows that repeat an id have the passages of each; other columns are ignored.
    """
    whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null")
    width = min_words - SHINGLE_WORDS + 1
    windows = whole.mapInArrow(_windows(width), ROW)
    met = cut_lineage(windows.repartition("key").sortWithinPartitions("key", "doc_id", "l").mapInArrow(_link, f"{LINK}, key long, c int"), "links")
    crowd = met.where("b is null").select("key", F.col("a").alias("doc_id"), F.col("al").alias("l"), F.col("ar").alias("r"), "c")
    links = met.where("b is not null").drop("key", "c").unionByName(_crowded_links(whole, crowd, width, _least(width, percent)))
    pairs = cut_lineage(links.groupBy("a", "b").agg(
        F.min("al").alias("al"), F.max("ar").alias("ar"), F.min("bl").alias("bl"), F.max("br").alias("br")
    ), "pairs")
    return _meet(whole, pairs).mapInArrow(
        _verify(width, percent), "doc_id long, start_word long, n_words long, source_id long, source_word long"
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        for rows, data, offsets in chunks(batch, "text"):
            _, row, start, end = words(data, offsets)
            bounds, kept = np.searchsorted(row, np.arange(len(offsets))), []
            for k in range(len(offsets) - 1):
                text, first, last = data[offsets[k] : offsets[k + 1]], start[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]]
                gone = np.zeros(len(text), bool)
                for span in spans[rows.start + k].as_py() or ():
                    a, b = span["start_word"], span["start_word"] + span["n_words"]
                    gone[first[a] - offsets[k] : (first[b] if b < len(first) else last[-1]) - offsets[k]] = True
                kept.append(text[~gone].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(rows.start, len(kept)), pa.array(kept, pa.string())], names=["row", "cut"]
            )


def remove_passages(docs: DataFrame, passages: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the words of ``passages`` cut from the text; all rows and columns stay, a null text stays null.

    Only rows that have a passage pass through Python.
    """
    spans = passages.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    joined = docs.select(F.struct(*docs.columns).alias("row")).join(spans, F.col(f"row.{id_column}") == F.col("_id"), "left")
    joined = joined.select("row", F.col(f"row.{text_column}").alias("text"), "spans")
    row_type = docs.select(F.struct(*docs.columns).alias("row")).schema["row"].dataType.simpleString()
    cut = joined.where("spans is not null and text is not null").mapInArrow(_cut, f"row {row_type}, cut string")
    rest = joined.where("spans is null or text is null").select("row", F.col("text").alias("cut"))
    return cut.unionByName(rest).select(*[F.col("cut").alias(c) if c == text_column else F.col(f"row.{c}").alias(c) for c in docs.columns])



