"""Operators over documents against brute force on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberframe.llm import lm, near, packing, passages, pieces, rules, substrings
from emberframe.llm import text as text_module

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, key long, row string, rep long, n_words int, same string, part string, block string"


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = fresh(60)
    out: list[tuple[int | None, str | None]] = []
    for i in range(60):
        words = fresh(rng.randint(1, 160))
        if i % 6 == 0:
            words = words[:40] + passage + words[40:]
        out.append((i, " ".join(words)))
    base = fresh(150)
    for i in range(60, 90):  # near copies, from one to many edits
        copy = list(base)
        for _ in range(rng.randint(0, 14)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append((i, " ".join(copy)))
    out += [(90, out[5][1]), (91, out[5][1]), (92, None), (93, ""), (94, " \t\n\r\x0b\x0c "), (95, "One  two\tTHREE"), (96, "one two three")]
    out += [(97, " ".join(fresh(9000))), (98, "x" * 350), (99, "x" * 350 + "y"), (100, "ab " * 200), (101, "ÀÉ ß▁ \u001c😀\n" * 30)]
    out += [(7, out[7][1]), (-5, out[8][1])]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = ("en", 1, "r", 2, 3, "s", "p", "b")
    return spark.createDataFrame([(i, t, *extra) for i, t in [*rows, (None, "no id " * 30)]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = lower(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_packing_covers_every_token_once(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, window=256, open_windows=8).collect()
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in [*rows, (None, "no id " * 30)])
    by_doc = collections.defaultdict(list)
    for r in got:
        ids = tuple(np.frombuffer(r["tokens"], "<u4").tolist())
        assert len(ids) == r["length"]
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for (i, ids), times in want.items():
        for start in range(0, len(ids), 256):
            assert by_doc[i].count((start, ids[start : start + 256], len(ids))) >= times
    assert sum(len(x[1]) for v in by_doc.values() for x in v) == sum(len(k[1]) * n for k, n in want.items())
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces_ in sequences.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert total > 0.93 * 256 * len(sequences)
    assert packing.pack(empty, path).count() == 0


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, limit=50)
    samples = [
        "it's I'LL 12ab ab12", "<|endoftext|> x<|startoftext|>y", "á é b c", "ÀÈß ÿŒ _x_ a-b... #!", "İstanbul ΣΑΣ", "", " \x1c a\x1fb", "  lead trail \n", "...", "a.b.c é!! !?x ß's \x0b\x0c",
        *(t or "" for _, t in texts(9)),
    ]
    for _ in range(2):
        for text, ids in zip(samples, encoder.encode([s.encode() for s in samples])):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    samples = ["Two  words\n", "", "it's ÀÈ 12ab", *(t or "" for _, t in texts(4))]
    got = encoder.encode([s.encode() for s in samples])
    assert not encoder.by_word and [x.tolist() for x in got] == [tokenizer.encode(s, add_special_tokens=False).ids for s in samples]


def test_bounded_windows_keep_to_their_number():
    windows = packing.OpenWindows(10, 3)
    for k, length in enumerate([6, 7, 8, 5, 4, 9, 1, 10, 2]):
        windows.place(length, k)
        assert len(windows.held) <= 3
    assert sorted(w for w, _ in ((r[0], r[1]) for r in windows.rest())) == sorted(r[0] for r in windows.rest())


def components(rows, percent=75):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_equal_brute_force(docs, rows, empty):
    got = {r["doc_id"]: r for r in near.near_duplicates(docs).collect()}
    want = components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert near.near_duplicates(empty).count() == 0


def test_near_duplicates_lose_no_link_in_a_crowded_region(spark, monkeypatch):
    """Texts on one template (similarity 0.67), a few pairs of them at 0.77; neighbours meet one place on each side only."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    template = [word() for _ in range(170)]
    rows, common = [], []
    for i in range(500):
        if i % 25 != 1:
            common = [] if i % 25 else [word() for _ in range(14)]
        rows.append((i, " ".join(template + common + [word() for _ in range(36 - len(common))])))
    rows += [(500, rows[3][1]), (501, None), (3, rows[3][1]), (502, " ".join(template[:150])), (503, " ".join(template + ["x"] * 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = components(rows)
    monkeypatch.setattr(near, "REACH", 1)
    found = lambda: {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs).collect()}
    assert found() == want
    monkeypatch.setattr(near, "CROWDED", near.TREES + 1)
    assert found() != want  # the forest alone passes some by


def test_prefix_join_equals_all_pairs(spark):
    """Random sets of all sizes over few words: every pair that is similar enough is a candidate."""
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(240):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 3
        rows.append((i, " ".join(w[: rng.randint(max(1, len(w) * 2 // 3), len(w))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    for percent in (75, 50, 100):
        alike = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = near.prefix_pairs(docs, docs.select("doc_id", F.col("doc_id").alias("component")), percent)
        assert alike <= {(r["a"], r["b"]) for r in got.collect()}
        assert {(r["u"], r["v"]) for r in near.confirm(docs, got, percent).collect()} == alike


def test_confirm_deals_out_a_text_with_many_visitors(spark, monkeypatch):
    monkeypatch.setattr(near, "VISITORS", 2)
    same = spark.createDataFrame([(i, "a b c d e f g") for i in range(9)], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 9)], "a long, b long")
    met = near.meet(same, pairs)
    assert met.where("visit = 0").count() == 4
    assert near.confirm(same, pairs, 75).count() == 8


def removed(rows, length=100):
    by_id = {}
    for i, t in rows:
        by_id[i] = min(by_id.get(i, t or ""), t or "")
    seen, out = set(), {}
    for i in sorted(by_id):
        data = by_id[i].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("parts", ["2", "7"])
def test_substring_ranks_equal_brute_force(spark, docs, rows, empty, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = substrings.deduplicate(docs).collect()
        assert {r["doc_id"]: (r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got} == removed(rows)
        assert len(got) == len(removed(rows))
        assert substrings.deduplicate(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_substring_ranks_on_repetitive_texts(spark):
    rng = random.Random(5)
    block = "".join(rng.choices("ab", k=260))
    some = [(k, "".join(rng.choice([block[a : a + n], "".join(rng.choices("ab", k=n))]) for a, n in [(rng.randrange(150), rng.randrange(20, 140)) for _ in range(6)])) for k in range(40)]
    frame = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.deduplicate(frame).collect()}
    assert got == removed(some)


def test_compact_windows_cover_every_range_once():
    rng = np.random.default_rng(4)
    for n, width in ((30, 5), (57, 8), (12, 12), (9, 10)):
        value, row = rng.integers(0, 1 << 62, n).astype(np.uint64), np.repeat([0, 1], [n // 3, n - n // 3])
        value[3] = value[min(7, n - 1)]
        found = list(zip(*(x.tolist() for x in passages.compact_windows(value, row, width))))
        for i in range(n):
            for j in range(i + width - 1, n):
                if row[i] == row[j]:
                    inside = [(l, c, r) for l, c, r in found if l <= i <= c <= j <= r]
                    part = (value[i : j + 1] >> np.uint64(31)).tolist()
                    assert len(inside) == 1 and inside[0][1] == i + part.index(min(part))


def test_compact_windows_of_a_long_ascent_take_no_quadratic_work():
    """The last value is the least, and its node passes all others; a repeated text has equal, that is ascending, values."""
    n = 200_000
    rising = np.r_[np.arange(1, n + 1, dtype=np.uint64) << np.uint64(31), np.uint64(0)]
    began = time.process_time()
    for value, back in ((rising, False), (rising[::-1].copy(), True)):
        l, c, r = passages.compact_windows(value, np.zeros(n + 1, np.int64), 5)
        k = np.flatnonzero(c == (0 if back else n))[0]
        assert (l[k], r[k], len(c)) == (0, n, n - 3)
    assert time.process_time() - began < 30


def test_passages_are_found_and_nothing_else(docs, rows, empty):
    got = passages.repeated_passages(docs).collect()
    by_id = {i: lower(t) for i, t in rows}
    for r in got:
        assert r["source_id"] < r["doc_id"] and r["n_words"] >= 50
        mine = by_id[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        other = by_id[r["source_id"]][max(0, r["source_word"] - 6) : r["source_word"] + r["n_words"] + 6]
        one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (mine, other))
        assert len(one & two) >= 0.8 * len(one)
    found = {r["doc_id"] for r in got}
    grams = collections.defaultdict(set)
    for i, w in by_id.items():
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(i)
    exact = {i for ids in grams.values() for i in ids if i != min(ids)}
    assert exact <= found
    shared = collections.Counter()
    for i in by_id:
        for j in by_id:
            if i < j and len(shingle_set(" ".join(by_id[i])) & shingle_set(" ".join(by_id[j]))) >= 30:
                shared[j] += 1
    assert found <= set(shared)
    assert passages.repeated_passages(empty).count() == 0


def fresh_words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]


def covered(got, doc: int) -> set[int]:
    return {w for r in got if r["doc_id"] == doc for w in range(r["start_word"], r["start_word"] + r["n_words"])}


def test_passages_repeated_within_a_document_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(passages, "chunks", lambda batch, text: text_module.chunks(batch, text, 1))  # a document per chunk
    passage = fresh_words(1, 60)
    twice = passage + fresh_words(2, 3000) + passage
    some = [(1, " ".join(passage)), (2, " ".join(twice))]
    got = passages.repeated_passages(spark.createDataFrame(some, "doc_id long, text string").coalesce(1)).collect()
    assert covered(got, 2) >= {*range(60), *range(3060, 3120)}


def test_windows_keep_every_range_of_a_signature():
    passage = fresh_words(1, 60)
    some = [(1, " ".join(passage + fresh_words(2, 700) + passage)), (2, " ".join(passage)), (3, " ".join(passage))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in some]), pa.array([t for _, t in some])], names=["doc_id", "text"])
    rows = [r for b in passages._windows(46)(iter([batch])) for r in b.to_pylist()]
    assert max(r["r"] for r in rows if r["doc_id"] == 1 and r["l"] < 60) > 760
    # The same content leaves as a link to its first document, which is sent itself.
    assert {r["other"] for r in rows if r["doc_id"] == 3} == {2}
    assert {r["other"] for r in rows if r["doc_id"] == 2} == {None}


def stretches(one: list[str], other: list[str]) -> list[tuple[int, int, int]]:
    value = lambda w: text_module.shingles(*text_module.words(np.frombuffer(t := " ".join(w).encode(), np.uint8), np.array([0, len(t)]))[:2])[0]
    return passages.matches(value(one), value(other), 46, 40)


def test_matches_count_every_place_of_a_shingle():
    sentence, passage = fresh_words(3, 11), fresh_words(4, 39)
    text = passage[:20] + sentence + passage[20:]
    assert stretches(sentence + fresh_words(5, 30) + text, text) == [(0, 46, 41)]
    refrain = fresh_words(6, 5) * 12
    assert stretches(refrain, refrain) == [(0, 56, 0)]
    assert stretches(fresh_words(7, 20) + refrain, fresh_words(8, 40) + refrain + fresh_words(9, 40))[0][2] in range(14, 21)
    same = ["ab"] * 9000  # one value, convolved
    assert stretches(same, same) == [(0, 8996, 0)]
    found = stretches(["ab"] * 60, same)  # a short source covers a long run piece by piece
    assert {w for s, n, _ in found for w in range(s, s + n)} == set(range(8996))


def test_only_shift_is_the_first_main_shift():
    rng, seen = np.random.default_rng(6), 0
    for _ in range(300):
        one = rng.permutation(400).astype(np.uint64)
        other = one[(start := rng.integers(0, 250)) : start + rng.integers(60, 140)]
        other = np.delete(other, rng.integers(0, len(other), rng.integers(0, 9)))
        other[rng.integers(0, len(other), 3)] = 1000
        order, ordered = np.argsort(one), np.sort(one)
        low, high = np.searchsorted(ordered, other), np.searchsorted(ordered, other, side="right")
        main = passages._only_shift(order, low, high - low)
        if main is not None:
            seen += 1
            assert main == next(passages._main_shifts(order, low, high, 1))
    assert seen > 50


def test_removed_passages_leave_the_rest(docs, rows, spark):
    spans = spark.createDataFrame([(3, 1, 2, 0, 0), (3, 2, 3, 0, 0), (95, 0, 3, 1, 0), (92, 0, 1, 1, 0)], "doc_id long, start_word long, n_words long, source_id long, source_word long")
    cut = passages.remove_passages(docs, spans)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    got = {r["doc_id"]: r["text"] for r in cut.where("doc_id in (3, 95, 92, 4)").collect()}
    text = dict(rows)
    assert got[3].split() == text[3].split()[:1] + text[3].split()[5:]
    assert got[95].strip() == "" and got[92] is None and got[4] == text[4]


def test_grams_and_counts_pack_and_unpack():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        for top in (2**8, 2**40, 2**64 - 1):
            grams = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            assert (lm._unpack(lm._pack(grams), n) == grams).all()
        counts = rng.choice([1, 2, 254, 255, 256, 10**12], n)
        assert (lm._unpack_counts(lm._pack_counts(counts), n) == counts).all()
    grams = np.unique(rng.integers(0, 2**64 - 1, 1 << 20, dtype=np.uint64))
    assert len(lm._pack(grams)) < 6.1 * len(grams)


def test_stupid_backoff_equals_counting(docs, rows, empty):
    from math import log

    whole = [*rows, (None, "no id " * 30)]
    counts = collections.Counter()
    for _, t in whole:
        w = lower(t)
        for n in (1, 2, 3):
            counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def score(w, k, order):
        order = min(order, k + 1)
        if order == 1:
            return log(counts[(w[k],)] / total), 1
        gram = tuple(w[k - order + 1 : k + 1])
        if counts[gram] >= 2:
            return log(counts[gram] / counts[gram[:-1]]), order
        lower_, used = score(w, k, order - 1)
        return log(0.4) + lower_, used

    for order in (1, 2, 3):
        got = collections.Counter()
        for r in lm.stupid_backoff(docs, order=order).collect():
            got[r["doc_id"], r["n_words"], round(r["log_score"], 6), r["n_backoff"]] += 1
        want = collections.Counter()
        for i, t in whole:
            w = lower(t)
            scored = [score(w, k, order) for k in range(len(w))]
            want[i, len(w), round(sum(s for s, _ in scored), 6), sum(u < min(order, k + 1) for k, (_, u) in enumerate(scored))] += 1
        assert got == want
    assert lm.stupid_backoff(empty).count() == 0


def test_pieces_round_trip_and_are_distinct(docs, rows, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, model, samples=3, seed=5)
    got = pieces.decode(encoded.withColumn("mark", F.crc32("ids")), model).collect()
    text = {i: (t or "").encode() for i, t in [*rows, (None, "no id " * 30)]}
    marks = collections.defaultdict(list)
    for r in got:
        assert r["decoded"] == text[r["doc_id"]]
        marks[r["doc_id"]].append((r["sample"], r["mark"], r["gumbel"]))
    for i, found in marks.items():
        assert len({m for _, m, _ in found}) == len({s for s, _, _ in found})
        best = dict((s, g) for s, _, g in found)
        assert [best[s] for s in sorted(best)] == sorted(best.values(), reverse=True)
    assert len(marks[93]) == 1  # an empty text has one segmentation
    again = {(r["doc_id"], r["sample"]): zlib.crc32(r["ids"]) for r in pieces.encode(docs.repartition(1), model, samples=3, seed=5).collect()}
    assert again == {(r["doc_id"], r["sample"]): r["mark"] for r in got}
    assert pieces.encode(empty, model).count() == 0


def test_samples_without_replacement_are_unbiased():
    """Summed inverse inclusion scores estimate one for every segmentation, and first samples follow the model."""
    vocab = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    first, weight, chance, n = collections.Counter(), collections.Counter(), {}, 3000
    texts_ = ["thea"] * n
    for k, batch in enumerate(pieces._encode_chunk(vocab, list(range(n)), texts_, 3, 11)):
        for r in batch.to_pylist():
            chance[r["ids"]] = np.exp(r["log_prob"])
            first[r["ids"]] += k == 0
            weight[r["ids"]] += 1 / r["inclusion"]
    assert 0.98 < sum(chance.values()) < 1.0001
    for ids, p in chance.items():
        assert abs(first[ids] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3
        if p > 0.005:
            assert abs(weight[ids] / n - 1) < 0.25


def statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_text_statistics_equal_python(spark, docs, rows):
    more = [(200, "a b c a b c a b\n\n x \nx\n x \n#*|"), (201, "a a a a"), (202, "\n\n"), (203, "a b a b a b c"), (204, "x y z q x y z"), (205, "a b  c\u0085 d")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).where("doc_id is not null")
    got = collections.Counter(tuple(r) for r in rules.text_statistics(frame).select("doc_id", *rules.STATS).collect())
    assert got == collections.Counter((i, *statistics(t)) for i, t in [*rows, *more])


def test_decision_list_learns_and_keeps(spark, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(rng.randint(60, 200)))) for i in range(300)]
    symbols = [(i, " ".join(word() + "###" for _ in range(rng.randint(60, 200)))) for i in range(300, 360)]
    shouts = [(i, " ".join(word().upper() + "!!" for _ in range(rng.randint(60, 200)))) for i in range(360, 420)]
    frame = spark.createDataFrame([*good, *symbols, *shouts, (420, None), (421, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 420, 2)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    judged, learned = rules.apply_rules(frame, labels)
    kept = {r["doc_id"]: r["kept"] for r in judged.collect()}
    unseen = [i for i in range(1, 420, 2)]
    assert sum(kept[i] == (i < 300) for i in unseen) >= 0.97 * len(unseen)
    assert not kept[420] and not kept[421] and 1 <= len(learned.rules) <= 6
    assert "reject" in str(learned)
    judged, none = rules.apply_rules(frame, spark.createDataFrame([], labels.schema))
    assert not none.rules and judged.where("kept").count() == 420
    assert rules.apply_rules(empty, labels)[0].count() == 0


def shared_lines(n: int, lines: int, size: int, seed: int = 1) -> list[tuple[int, str]]:
    """Texts of ten lines each, drawn from a few that many texts share."""
    rng = np.random.default_rng(seed)
    drawn = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, size)) for _ in range(lines)]
    return [(i, "\n".join(drawn[k] for k in rng.integers(0, lines, 10))) for i in range(n)]


@pytest.mark.parametrize(("n", "lines", "size"), [(300, 60, 18), (300, 60, 27), (600, 200, 27)])
def test_passages_of_frequent_lines_are_found(spark, monkeypatch, n, lines, size):
    """Every signature of such a passage may belong to a line that other, unrelated texts hold first."""
    monkeypatch.setattr(passages, "chunks", lambda batch, text: text_module.chunks(batch, text, 1))  # a document per chunk
    some = shared_lines(n, lines, size)
    grams = collections.defaultdict(set)
    for i, text in some:
        words = text.split()
        for k in range(len(words) - 49):
            grams[tuple(words[k : k + 50])].add(i)
    want = {i for ids in grams.values() for i in ids if i != min(ids)}
    got = passages.repeated_passages(spark.createDataFrame(some, "doc_id long, text string"))
    found = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    assert len(want) > 5 and len(want - found) <= 0.02 * len(want)


@pytest.mark.parametrize("block", [1024, 40])
def test_passages_meet_every_holder_of_a_signature(spark, monkeypatch, block):
    """Every line stands in a third of the texts, so the first holder of a signature and the one before are mostly unrelated."""
    monkeypatch.setattr(passages, "chunks", lambda batch, text: text_module.chunks(batch, text, 1))  # a document per chunk
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = np.random.default_rng(1)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 18)) for _ in range(90)]
    some = [(i, "\n".join(lines[k] for k in rng.integers(0, 90, 30))) for i in range(1000)]
    grams = collections.defaultdict(set)
    for i, text in some:
        words = text.split()
        for k in range(len(words) - 49):
            grams[tuple(words[k : k + 50])].add(i)
    got = passages.repeated_passages(spark.createDataFrame(some, "doc_id long, text string"))
    found = {r["doc_id"] for r in got.select("doc_id").distinct().collect()}
    want = {i for ids in grams.values() for i in ids if i != min(ids)}
    assert len(want) > 300 and want <= found


def test_rows_of_a_signature_meet_by_stretches():
    rng = np.random.default_rng(2)
    fresh = lambda n: rng.integers(1, 1 << 32, n).astype(np.uint32)
    around, least = lambda left, middle, right: np.r_[fresh(left), middle, fresh(right)], fresh(115)
    shared = np.stack([
        least, around(20, least[20:66], 49), around(12, least[12:110], 5), around(20, least[20:66], 49), around(40, least[40:70], 45),
        np.r_[least[:20], fresh(1), least[21:66], fresh(49)],
    ])
    for doc in (np.arange(6), np.array([0, 1, 2, 3, 4, 5]) * 7):
        # All meet the first but the row that has 30 shingles of it only.
        assert set(passages._chosen(doc, shared, 46, 40)) == {(0, 1), (0, 2), (0, 3), (0, 5)}
    # Without the first: the stretch of the second is met again, what goes beyond it has no other holder.
    assert set(passages._chosen(np.arange(4), shared[[4, 1, 2, 3]], 46, 40)) >= {(1, 2), (1, 3)}
    assert passages._chosen(np.zeros(6, np.int64), shared, 46, 40) == []


def test_few_windows_of_a_signature_are_linked_all_with_all():
    keys = [1] * 3 + [2] * 5 + [3] * 2 + [4]
    n = len(keys)
    ints = lambda x: pa.array([x] * n, pa.int32())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(range(n)), ints(0), ints(60), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 2, ints(9)],
        names=["key", "doc_id", "l", "r", "other", "ol", "orr", "c"],
    )
    for cuts in ([0, n], [0, 1, 4, 5, 8, 9, n], list(range(n + 1))):
        rows = [r for b in passages._link(batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:])) for r in b.to_pylist()]
        assert sorted((r["a"], r["b"]) for r in rows if r["b"] is not None) == [(0, 1), (0, 2), (1, 2), (8, 9)]
        assert sorted((r["a"], r["key"], r["c"]) for r in rows if r["b"] is None) == [(i, 2, 9) for i in range(3, 8)]
