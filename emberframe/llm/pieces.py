"""Sampled segmentations into pieces of a SentencePiece vocabulary, without replacement, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberframe.llm.text import mix

CHUNK_CHARS = 1 << 18
ROWS = 512  # texts that are held as strings at once
ENCODED = "doc_id long, sample int, ids binary, n_pieces long, log_prob double, gumbel double, inclusion double"
_LINE, _BLANK = 10, 32


class PieceBytes:
    """The bytes that each piece stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        data = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                data.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                data.append(b"")
            else:
                data.append(model.id_to_piece(i).replace("▁", " ").encode())
        self.length = np.array([len(b) for b in data])
        self.flat, self.start = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(self.length)[:-1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text, without the blank that encoding puts in front."""
        return self.flat[_within(self.start[ids], self.length[ids])].tobytes()[1:]


class Vocabulary:
    """Pieces as a trie over code points, with log probabilities.

    The model file ranks its pieces but has no probabilities; a piece of rank r gets a weight of 1 / (r + 2), a byte
    piece that of the last rank. A character without a piece of its own is written as byte pieces, as is the mark that stands for a blank
    in the vocabulary, so that every text can be read back.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        plain: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece.replace("▁", " ")] = i
        weight = {i: 1.0 / (2.0 - model.get_score(i)) for i in plain.values()}
        last = min(weight.values())
        total = sum(weight.values()) + 256 * last
        self.log_byte = float(np.log(last / total))
        steps: dict[tuple[int, int], int] = {}
        ids, logs = [-1], [0.0]
        for piece, i in plain.items():
            node = 0
            for c in piece:
                if (node, ord(c)) not in steps:
                    steps[node, ord(c)] = len(ids)
                    ids.append(-1)
                    logs.append(0.0)
                node = steps[node, ord(c)]
            ids[node], logs[node] = i, float(np.log(weight[i] / total))
        self.ids, self.logs = np.array(ids), np.array(logs)
        self.low = np.zeros((len(ids), 256), np.int32)
        high = sorted((node << 32 | c, to) for (node, c), to in steps.items() if c >= 256)
        for (node, c), to in steps.items():
            if c < 256:
                self.low[node, c] = to
        self.high = np.array([k for k, _ in high] or [-1]), np.array([v for _, v in high] or [0])
        self.longest = max(map(len, plain))

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next nodes; 0 where the trie ends."""
        out = self.low[node, np.minimum(char, 255)]
        if (far := np.flatnonzero(char >= 256)).size:
            key = node[far].astype(np.int64) << 32 | char[far]
            at = np.minimum(np.searchsorted(self.high[0], key), len(self.high[0]) - 1)
            out[far] = np.where(self.high[0][at] == key, self.high[1][at], 0)
        return out


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> PieceBytes:
    return PieceBytes(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of several ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Lattice:
    """All segmentations of the distinct units of a chunk.

    No piece crosses into a blank or over a line end, so the lattice of a text is a chain of those of its units. Every
    edge has the probability that a segmentation which comes by its start goes on with it.
    """

    def __init__(self, vocab: Vocabulary, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        size = lengths + 1  # one more place marks the end
        self.first = np.cumsum(size) - size
        n = int(size.sum())
        text = np.zeros(n, np.int64)
        inside = _within(self.first, lengths)
        text[inside] = chars[_within(starts, lengths)]
        end = np.repeat(self.first + lengths, size)
        self.text = text
        source, node, place, target, value, name = inside, np.zeros(len(inside), np.int64), [], [], [], []
        for k in range(vocab.longest):
            ok = source + k < end[source]
            source, node = source[ok], node[ok]
            node = vocab.step(node, text[source + k])
            source, node = source[node > 0], node[node > 0]
            if not len(source):
                break
            is_piece = vocab.ids[node] >= 0
            place.append(source[is_piece])
            target.append(source[is_piece] + k + 1)
            value.append(vocab.logs[node[is_piece]])
            name.append(vocab.ids[node[is_piece]])
        single = np.zeros(n, bool)
        if place:
            single[place[0]] = True
        bare = inside[~single[inside]]
        width = 1 + (text[bare] >= 0x80) + (text[bare] >= 0x800) + (text[bare] >= 0x10000)
        place.append(bare)
        target.append(bare + 1)
        value.append(vocab.log_byte * width)
        name.append(np.full(len(bare), -1))
        place, target, value, name = (np.concatenate(x) for x in (place, target, value, name))
        order = np.argsort(place, kind="stable")
        self.place, self.target, value, self.name = place[order], target[order], value[order], name[order]
        self.edges = np.searchsorted(self.place, np.arange(n + 1))
        # Mass of all ways to the end, from the end backwards over all units at once.
        rest = np.zeros(n)
        distance = (end - np.arange(n))[self.place]
        by = np.argsort(distance, kind="stable")
        cuts = np.searchsorted(distance[by], np.arange(1, int(distance.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = by[a:b]
            if len(e):
                at = np.flatnonzero(np.r_[True, self.place[e][1:] != self.place[e][:-1]])
                total = np.logaddexp.reduceat(value[e] + rest[self.target[e]], at)
                rest[self.place[e][at]] = total
        self.log = value + rest[self.target] - rest[self.place]
        self.p = np.exp(self.log)
        self.end = end

    def choose(self, place: np.ndarray, u: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """An edge for each place, by inverse distribution; ``out`` lists edges per row that are not to be taken."""
        edge, last = self.edges[place].copy(), self.edges[place + 1] - 1
        left, on = u.copy(), np.arange(len(place))
        best = np.full(len(place), -1)
        while len(on):
            e = edge[on]
            free = np.ones(len(on), bool) if out is None else (out[on] != e[:, None]).all(axis=1)
            left[on] -= np.where(free, self.p[e], 0)
            best[on] = np.where(free, e, best[on])
            on = on[~(free & (left[on] < 0)) & (e < last[on])]
            edge[on] += 1
        return best


def _uniform(seed: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    bits = mix(seed + mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _truncated(bound: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values around ``location`` that lie below ``bound``."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        free = location - np.log(-np.log(u))
        return np.where(np.isneginf(location), -np.inf, bound - np.logaddexp(0, bound - free))


class Search:
    """Perturbed A-star over the segmentations of every text of a chunk.

    A node of the search is a set of segmentations that share a prefix and take, at its end, none of some edges. Its
    key is the largest perturbed score in the set, a Gumbel value around the log mass of the set, drawn below that of the
    set it was split from. The node with the largest key gives the next segmentation and splits into the sets
    that leave it at each later place. So the k-th segmentation taken is the one with the k-th largest perturbed score.
    """

    def __init__(self, vocab: Vocabulary, texts: list[str], seeds: np.ndarray):
        raw = np.frombuffer(("".join(" " + t for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        self.seeds, self.n = seeds, len(texts)
        before = np.r_[_LINE, raw[:-1]]
        new = (before == _LINE) | (raw == _LINE) | ((raw == _BLANK) & (before != _BLANK))
        new[self.bounds[:-1]] = True
        self.start = np.flatnonzero(new)
        length = np.diff(np.r_[self.start, len(raw)])
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        step = np.uint64(0xD6E8FEB86659FD93)
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(length.max()) - 1, step)])
        within = np.arange(len(raw)) - np.repeat(self.start, length)
        name = np.add.reduceat(mix(raw.astype(np.uint64) + np.uint64(1)) * power[within], self.start)
        _, first, self.unit = np.unique(mix(name + length.astype(np.uint64)), return_index=True, return_inverse=True)
        self.lattice = Lattice(vocab, raw, self.start[first], length[first])
        self.vocab = vocab

    def walk(self, unit_at: np.ndarray, place: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free choices from ``place`` to the end of each unit: (document, place in the chunk, edge), in order."""
        keys, edges, on = [], [], np.flatnonzero(place < self.lattice.end[place])
        shift = self.start[unit_at] - self.lattice.first[self.unit[unit_at]]
        seeds = self.seeds[self.doc[unit_at]]
        base = self.bounds[self.doc[unit_at]]
        while len(on):
            key = place[on] + shift[on]
            edge = self.lattice.choose(place[on], _uniform(seeds[on], key - base[on], salt))
            keys.append(key)
            edges.append(edge)
            place[on] = self.lattice.target[edge]
            on = on[place[on] < self.lattice.end[place[on]]]
        key, edge = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, edges))
        order = np.argsort(key, kind="stable")
        key = key[order]
        return np.searchsorted(self.bounds, key, side="right") - 1, key, edge[order]

    def _split(self, doc, key, edge, before, bound, path, k, salt):
        """The sets that leave a path: at each place, all but its edge."""
        with np.errstate(divide="ignore"):
            mass = before + np.log(np.maximum(1 - self.lattice.p[edge], 0))
        mass[1 - self.lattice.p[edge] < 1e-12] = -np.inf
        out = np.full((len(edge), k + 1), -1)
        out[:, 0] = edge
        u = _uniform(self.seeds[doc], key - self.bounds[doc], salt)
        return {"doc": doc, "key": key, "before": before, "g": _truncated(bound[doc], mass, u), "path": np.full(len(doc), path), "out": out}

    def run(self, k: int) -> list[dict]:
        """Per sample: documents, their scores, keys, and the edges of all of them in order; last the next key of every document."""
        lattice, units = self.lattice, np.arange(len(self.start))
        doc, key, edge = self.walk(units, lattice.first[self.unit].copy(), 1)
        value = lattice.log[edge]
        total = np.bincount(doc, weights=value, minlength=self.n)
        before = np.cumsum(value) - value
        before -= before[np.searchsorted(key, self.bounds[:-1])][doc] if len(doc) else 0
        bound = -np.log(-np.log(_uniform(self.seeds, np.zeros(self.n, np.int64), 2)))
        every = np.arange(self.n)
        found = [{"docs": every, "log_prob": total, "gumbel": bound, "doc": doc, "key": key, "edge": edge}]
        sets = self._split(doc, key, edge, before, bound, 0, k, 3)
        for j in range(1, k + 1):
            best = np.full(self.n, -np.inf)
            np.maximum.at(best, sets["doc"], sets["g"])
            if j == k:
                found.append({"next": best})
                break
            hit = np.flatnonzero((sets["g"] == best[sets["doc"]]) & (best[sets["doc"]] > -np.inf))
            _, one = np.unique(sets["doc"][hit], return_index=True)
            hit = hit[one]
            d, at = sets["doc"][hit], sets["key"][hit]
            unit = np.searchsorted(self.start, at, side="right") - 1
            place = at - self.start[unit] + lattice.first[self.unit[unit]]
            out = sets["out"][hit]
            left = 1 - np.where(out >= 0, lattice.p[out], 0).sum(axis=1)
            salt = 10 * j
            other = lattice.choose(place, _uniform(self.seeds[d], at - self.bounds[d], salt) * left, out)
            head = sets["before"][hit] + lattice.log[other]
            # What follows: the rest of the unit, then the later units of the document.
            after = np.searchsorted(self.start, self.bounds[d + 1]) - unit - 1
            later = _within(unit + 1, after)
            ud, uk, ue = self.walk(np.r_[unit, later], np.r_[lattice.target[other], lattice.first[self.unit[later]]], salt + 1)
            score = lattice.log[ue]
            cum = np.cumsum(score) - score
            spot, slot = np.searchsorted(uk, self.bounds[d]), np.zeros(self.n, np.int64)
            slot[d] = np.arange(len(d))
            tail = np.bincount(ud, weights=score, minlength=self.n)[d]
            if len(ud):
                cum = cum - cum[np.minimum(spot, len(cum) - 1)][slot[ud]] + head[slot[ud]]
            parts = []
            for p in range(j):
                source = found[p]
                mine = np.full(self.n, -1)
                mine[d[sets["path"][hit] == p]] = at[sets["path"][hit] == p]
                use = source["key"] < mine[source["doc"]]
                parts.append((source["doc"][use], source["key"][use], source["edge"][use]))
            parts += [(d, at, other), (ud, uk, ue)]
            nd, nk, ne = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(nk, kind="stable")
            bound = best
            found.append({"docs": d, "log_prob": head + tail, "gumbel": best[d], "doc": nd[order], "key": nk[order], "edge": ne[order]})
            extra = self._split(ud, uk, ue, cum, bound, j, k, salt + 2)
            sets["out"][hit, j] = other
            left = left - lattice.p[other]
            with np.errstate(divide="ignore"):
                mass = np.where(left > 1e-12, sets["before"][hit] + np.log(np.maximum(left, 1e-300)), -np.inf)
            sets["g"][hit] = _truncated(best[d], mass, _uniform(self.seeds[d], at - self.bounds[d], salt + 3))
            sets = {c: np.concatenate([sets[c], extra[c]]) for c in sets}
        return found

    def ids(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge has."""
        name = self.lattice.name[edge]
        char = self.lattice.text[self.lattice.place[edge]]
        bare = name < 0
        count = np.where(bare, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000), 1)
        out = np.repeat(name, count)
        if bare.any():
            data = np.frombuffer(char[bare].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(bare, count)] = self.vocab.byte_id[data]
        return out, count


def encode(
    docs: DataFrame, model_path: str, *, samples: int = 2, seed: int = 1, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``samples`` distinct segmentations of every text: doc_id, sample (from 1), ids (little-endian unsigned 32-bit), n_pieces, log_prob, gumbel, inclusion.

    Segmentations are drawn without replacement with probabilities of a unigram model over the pieces; in order of their
    perturbed scores (``gumbel``). ``inclusion`` is the chance that a segmentation of that probability exceeds the next score,
    the weight to divide by in estimates; 1 if no other segmentation is left. The noise depends on ``seed``, the id and the place alone, so any order and partitioning
    of the rows gives the same samples. A text with fewer segmentations has fewer rows.

    A null or empty text is the blank that the vocabulary puts in front; a null id counts as -1 in the noise; repeated
    rows are encoded each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(t) + 1 for t in texts])
            first = 0
            while first < len(texts):
                limit = (ends[first - 1] if first else 0) + CHUNK_CHARS
                last = max(first + 1, int(np.searchsorted(ends, limit, side="right")))
                yield from _encode_chunk(vocab, ids[first:last], texts[first:last], samples, seed)
                first = last

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, ENCODED)


def _encode_chunk(vocab: Vocabulary, ids: list, texts: list[str], samples: int, seed: int) -> Iterator[pa.RecordBatch]:
    keys = np.array([-1 if i is None else i for i in ids], np.int64).astype(np.uint64)
    search = Search(vocab, texts, mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))))
    *found, rest = search.run(samples)
    for k, path in enumerate(found):
        flat, count = search.ids(path["edge"])
        ends = np.r_[0, np.cumsum(count)]
        cut = ends[np.searchsorted(path["doc"], path["docs"])], ends[np.searchsorted(path["doc"], path["docs"], side="right")]
        data = flat.astype("<u4").tobytes()
        bound = rest["next"][path["docs"]]
        with np.errstate(over="ignore"):
            inclusion = np.where(np.isneginf(bound), 1.0, -np.expm1(-np.exp(path["log_prob"] - bound)))
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([ids[d] for d in path["docs"]], pa.int64()), "sample": pa.array([k + 1] * len(path["docs"]), pa.int32()),
            "ids": pa.array([data[4 * a : 4 * b] for a, b in zip(*(c.tolist() for c in cut))], pa.binary()),
            "n_pieces": cut[1] - cut[0], "log_prob": path["log_prob"], "gumbel": path["gumbel"], "inclusion": inclusion,
        })


def decode(encoded: DataFrame, model_path: str, *, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (binary, UTF-8) in place of the ids: the exact text. Null ids give null."""
    kept = [f for f in encoded.schema.fields if f.name != ids_column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = piece_bytes(model_path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            text = [None if x is None else vocab.decode(np.frombuffer(x, "<u4")) for x in batch.column(ids_column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(text, pa.binary())], names=[f.name for f in kept] + ["decoded"]
            )

    return encoded.select(*[f.name for f in kept], ids_column).mapInArrow(run, schema)
