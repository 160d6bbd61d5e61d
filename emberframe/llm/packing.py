"""Bounded-space online packing of token ids into fixed windows."""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.text import chunks
from emberframe.session import cut_lineage

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, part int, tokens binary"
GROUP = 64  # partitions whose leftovers meet in one merge task


class WordEncoder:
    """Token ids of whole texts, with the ids of each blank-separated word kept in a bounded table.

    Vocabularies of the kind ``BY_WORD`` drop blanks and never join across them, so the ids of a text are those of its words. With any other
    tokenizer file whole texts are encoded.
    """

    #: The normaliser and pre-tokeniser under which a text may be taken word by word.
    BY_WORD = (
        {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
        ]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    )
    #: Letters whose lower case and composed form are the same everywhere, and ASCII marks that may follow them.
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]*")
    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, limit: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.by_word = (described["normalizer"], described["pre_tokenizer"]) == self.BY_WORD and described["model"]["type"] == "BPE"
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = {b: b if b in visible else next(hidden) for b in range(256)}
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Letters followed by marks cannot hold a special string that is not itself of this form.
        self.by_word &= not any(self.LETTERS.fullmatch(s.rstrip(self.MARKS).decode()) for s in special)
        self.tokenize = self.tokenizer.model.tokenize
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.parts: dict[str, array] = {}
        self.flat, self.ends = array("I"), array("i", [0])

    def _piece(self, part: str) -> array:
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[part] = array("I", [t.id for t in self.tokenize(shown)])
        return ids

    def _ids(self, word: bytes) -> array:
        core = word.rstrip(self.MARKS)
        letters = core.decode("utf-8", "replace")
        if core.isalpha() or self.LETTERS.fullmatch(letters):
            if len(core) == len(word):
                return self._piece(letters.lower())
            marks = self._piece(word[len(core) :].decode())
            return self._piece(letters.lower()) + marks if letters else marks
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _add(self, word: bytes) -> int:
        """Put a new word into the table."""
        if word not in self.index:
            self.index[word] = len(self.index)
            self.flat += self._ids(word)
            self.ends.append(len(self.flat))
        return self.index[word]

    def encode(self, texts: list[bytes] | pa.Array) -> list[np.ndarray]:
        """Ids of every text, given as bytes, or as an Arrow column where nulls count as empty."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.binary())
        texts = texts.cast(pa.binary()).fill_null(b"")
        if not self.by_word:
            whole = [t.decode("utf-8", "replace") for t in texts.to_pylist()]
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(whole, add_special_tokens=False)]
        if len(self.index) > self.limit:
            self.clear()
        # Only the different words of the texts are looked up. Blanks are ASCII, so bytes that are no UTF-8 do the split no harm.
        bare = pa.StringArray.from_buffers(len(texts), texts.buffers()[1], texts.buffers()[2], offset=texts.offset)
        split = pc.ascii_split_whitespace(bare)
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        different = words.dictionary.to_pylist()
        places = list(map(self.index.get, different))
        if None in places:
            places = [self._add(different[k]) if place is None else place for k, place in enumerate(places)]
        # The table as a list of ids per word, over the memory of the arrays; ``take`` copies what the texts need.
        lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int32)), pa.array(np.frombuffer(self.flat, np.uint32)))
        taken = lists.take(pa.array(np.array(places, np.int32)[words.indices.to_numpy()]))
        ends = np.asarray(taken.offsets)[np.asarray(split.offsets) - split.offsets[0].as_py()]
        values = np.asarray(taken.values)
        return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this worker process; the words it knows serve all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class OpenWindows:
    """At most ``most`` open windows; a piece goes where it fits best, and the fullest leaves when none has room."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.room, self.held, self.made = size, most, [], {}, 0

    def place(self, length: int, piece) -> list:
        """Put a piece in; the pieces of a window that had to leave come back."""
        out = []
        at = bisect_left(self.room, (length, -1))
        if at == len(self.room):
            if len(self.room) >= self.most:
                out = self.held.pop(self.room.pop(0)[1])
            left, window = self.size, self.made
            self.made += 1
            self.held[window] = []
        else:
            left, window = self.room.pop(at)
        self.held[window].append((window, self.size - left, piece))
        if left == length:
            out = out + self.held.pop(window)
        else:
            insort(self.room, (left - length, window))
        return out

    def rest(self) -> list:
        return [row for window in sorted(self.held) for row in self.held[window]]


def _rows(pieces: list, base: int, part: int | None) -> pa.RecordBatch:
    """Pieces (window, offset, (doc_id, start, ids, doc_tokens)) as a batch."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[2][0] for p in pieces], pa.int64()),
            pa.array([p[2][1] for p in pieces], pa.int64()),
            pa.array([len(p[2][2]) for p in pieces], pa.int64()),
            pa.array([p[2][3] for p in pieces], pa.int64()),
            pa.array([base + p[0] for p in pieces], pa.int64()),
            pa.array([p[1] for p in pieces], pa.int64()),
            pa.array([part] * len(pieces), pa.int32()),
            pa.array([p[2][2].astype("<u4").tobytes() for p in pieces], pa.binary()),
        ],
        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "part", "tokens"],
    )


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", window: int = 2048,
    open_windows: int = 64, end_id: int = 1, flush_rows: int = 4096,
) -> DataFrame:
    """Packed pieces: doc_id, start, length, doc_tokens, sequence_id, offset, tokens (little-endian unsigned 32-bit ids).

    Each partition packs its own rows in one pass with ``open_windows`` windows in memory. A document
    is cut only at multiples of ``window``, so its full windows stand alone and the rest stays whole. What is open at
    the end of a partition is packed anew, largest piece first, in groups of 64 partitions: at
    most 64 * open_windows windows meet in one task, whatever the size of the table.

    A null or empty text is the end id alone; repeated rows are packed each; a null id stays null;
    further columns are ignored; an empty table gives an empty result.
    """

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        windows, done, base = OpenWindows(window, open_windows), [], part << 32
        for batch in batches:
            ids = batch.column(id_column).to_pylist()
            for rows, _, _ in chunks(batch, text_column, 4 << 20):
                texts = batch.column(text_column).slice(rows.start, rows.stop - rows.start)
                for doc_id, tokens in zip(ids[rows], encoder.encode(texts)):
                    tokens = np.append(tokens, np.uint32(end_id))
                    for start in range(0, len(tokens), window):
                        piece = tokens[start : start + window]
                        done += windows.place(len(piece), (doc_id, start, piece, len(tokens)))
                    if len(done) >= flush_rows:
                        yield _rows(done, base, None)
                        done = []
        if done:
            yield _rows(done, base, None)
        if rest := windows.rest():
            yield _rows(rest, base, part)
        pa.default_memory_pool().release_unused()  # the worker may wait for long before its next task

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Largest piece first into the tightest of all windows."""
        windows = OpenWindows(window, max(table.num_rows, 1))
        pieces = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["part"], r["sequence_id"], r["offset"]))
        out = []
        for r in pieces:
            out += windows.place(r["length"], (r["doc_id"], r["start"], np.frombuffer(r["tokens"], "<u4"), r["doc_tokens"]))
        # Bit 62 keeps these sequence numbers apart from those of the first pass.
        return pa.Table.from_batches([_rows(out + windows.rest(), (1 << 62) | (key[0].as_py() << 32), None)])

    placed = cut_lineage(docs.select(id_column, text_column).mapInArrow(online, SCHEMA), "packed")
    merged = (
        placed.where("part is not null").withColumn("bundle", F.floor(F.col("part") / GROUP))
        .groupBy("bundle").applyInArrow(merge, SCHEMA)
    )
    return placed.where("part is null").unionByName(merged).drop("part")
