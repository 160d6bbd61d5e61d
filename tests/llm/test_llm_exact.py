"""Conversation repair, exact top-k search and hard negatives, each against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import negatives, repair, shards, topk
from emberframe.llm.repair import AFTER, ANSWERED, CUT, DOOMED, NAMES, START, WANTED

# ---- repair ----------------------------------------------------------------------------------------------------------


def every_repair(codes):
    """(cost, audit, roles) of all edits with at most two insertions at a place."""
    out = []

    def go(i, state, cost, audit, runs):
        if i == len(codes) and state in (START, ANSWERED):
            out.append((cost, audit))
        if runs < 2:
            go(i, AFTER[state, WANTED[state]], cost + 3, audit + "I", runs + 1)
        if i < len(codes):
            role, kind = codes[i] & 3, codes[i] >> 2
            go(i + 1, state, cost + 4, audit + "D", 0)
            if kind != DOOMED:
                extra = 3 if kind == CUT else 0
                go(i + 1, AFTER[state, WANTED[state]], cost + 3 + extra, audit + "R", 0)
                if (state, role) in AFTER:
                    go(i + 1, AFTER[state, role], cost + extra, audit + "K", 0)

    go(0, START, 0, "", 0)
    return min(out)


def test_search_finds_the_cheapest_edits():
    rng = random.Random(2)
    for _ in range(150):
        codes = bytes(rng.choice([0, 1, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randint(0, 5)))
        assert repair.cheapest_edits(codes) == every_repair(codes)
    assert repair.cheapest_edits(b"") == (0, "") and repair.cheapest_edits(bytes([0])) == (4, "D")


def test_search_of_long_conversations_is_linear():
    for codes in (bytes([1] * 20_000), bytes([0, 1, 2, 3] * 5_000), bytes([2, 1, 5, 9] * 5_000)):
        cost, audit = repair.cheapest_edits(codes)
        state, spent, i = START, 0, 0
        for letter in audit:
            if letter == "I":
                state, spent = AFTER[state, WANTED[state]], spent + 3
                continue
            role, kind = codes[i] & 3, codes[i] >> 2
            i += 1
            spent += {"D": 4, "R": 3, "K": 0}[letter] + (3 if letter != "D" and kind == CUT else 0)
            if letter != "D":
                state = AFTER[state, WANTED[state] if letter == "R" else role]
        assert i == len(codes) and state == ANSWERED and spent == cost


CONVERSATIONS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello!"), (1, 2, "assistant", "Hello!"), (1, 5, "user", "and"),
    (2, None, "user", "first"), (2, 3, "assistant", None), (2, 3, None, "odd."), (2, 9, "", "x."), (2, 9, "tool", "y.\n"),
    (None, 1, "user", "no id."), (None, 1, "assistant", " "), (3, 0, "system", " \n"), (4, None, None, None),
    (5, 0, "assistant", "a."), (5, 1, "assistant", "b."), (5, 2, "assistant", "word " * 40_000), (6, 0, "user", "Ü."), (6, -4, "user", "ü!"),
]


def repaired_by_hand(rows):
    by_id, out = {}, {}
    for conv, turn, role, text, present in rows:
        kept = by_id.setdefault(conv, [])
        if present:
            role, text = " " if role is None else role, " " if text is None else text
            kept.append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    for conv, kept in by_id.items():
        seen, codes, faults, rows_of = set(), [], [0, 0, 0], []
        for _, _, role, _, text in sorted(kept):
            tail, kind = text.rstrip(" \t\n\x0b\x0c\r"), 0
            if not tail:
                kind, faults[0] = DOOMED, faults[0] + 1
            elif (role, text) in seen:
                kind, faults[1] = DOOMED, faults[1] + 1
            elif tail[-1] not in ".!?":
                kind, faults[2] = CUT, faults[2] + 1
            seen.add((role, text))
            codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * kind)
            rows_of.append((role, text))
        cost, audit = repair.cheapest_edits(bytes(codes))
        turns = {t for known, t, *_ in kept if known}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows_of, rows_of[1:])]
        lines, state, at = [], START, 0
        for letter in audit:
            if letter == "I":
                lines, state = lines + [NAMES[WANTED[state]] + ":"], AFTER[state, WANTED[state]]
                continue
            role, text = rows_of[at]
            at += 1
            if letter != "D":
                role = NAMES[WANTED[state]] if letter == "R" else role
                state = AFTER[state, "sua".index(role[0])]
                lines.append(f"{role}:{text}")
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(lines))
    return out


def test_repairs_follow_the_rules(spark):
    schema = "conv_id long, turn long, role string, text string, present boolean, kind string, audit int"
    marked = [(*r, i % 7 != 3) for i, r in enumerate(CONVERSATIONS)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in marked], schema)
    for present, rows in (("present", marked), (None, [(*r, True) for r in CONVERSATIONS])):
        plans, repaired = repair.repair(frame, present)
        want = repaired_by_hand(rows)
        got = {r["conv_id"]: tuple(r)[1:] for r in plans.collect()}
        assert got == {conv: row[:-1] for conv, row in want.items()}
        texts: dict = {}
        for r in sorted(repaired.collect(), key=lambda r: r["position"]):
            texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert {conv: "\n".join(lines) for conv, lines in texts.items()} == {conv: row[-1] for conv, row in want.items() if row[-1]}
        hashed = {r[0]: r[1] for r in repair.digests(repaired).collect()}
        assert hashed == {conv: hashlib.sha256(row[-1].encode()).hexdigest() for conv, row in want.items() if row[-1]}
    plans, repaired = repair.repair(frame.limit(0))
    assert plans.count() == 0 and repaired.count() == 0 and repair.digests(repaired).count() == 0


def test_damage(spark):
    rows = [(i, t, "assistant", "One. Two!") for i in range(40) for t in (0, None)] + [(None, 1, None, None)]
    got = {}
    for r in repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["present"]))
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = (("user" if kind == 4 else role), {1: "", 2: text.replace(".", "").replace("!", "")}.get(kind, text), kind != 0)
        assert got[conv, turn] == [want] * (2 if kind == 3 else 1)


# ---- vectors ---------------------------------------------------------------------------------------------------------

FIELDS = "vec_id long, embedding array<double>, label int, v string, shard int, extra string"


def vectors(n=400, dim=22, seed=3):
    rng = np.random.default_rng(seed)
    data = np.round(rng.normal(size=(n, dim)) * 0.3, 3)
    data[7] = data[100] = data[250] = data[13]
    data[150] *= 1000
    labels = rng.integers(0, 4, n)
    rows = [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(data, labels))]
    odd = [(1000, None, 1), (1050, [float("nan")] + [1.0] * (dim - 1), 1), (1100, [None] + [1.0] * (dim - 1), 1), (1150, [1.0] * 5, 1),
           (1200, [float("inf")] * dim, 2), (None, data[0].tolist(), 1), (1250, [1e300] * dim, 1), (1300, [], 0)]
    return data, labels, [(*r, "x", 1, "y") for r in rows + odd + rows[50:52]]


def integer_scores(data):
    whole = np.floor(256 * data).astype(np.int64)
    return whole @ whole.T


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(shards, "LEAST_SHARD_ROWS", 90)


def test_batches_may_end_anywhere(spark, small_shards):
    """A batch may end in the rows of a shard, after the queries of another."""
    data, _, rows = vectors()
    frame, score = spark.createDataFrame(rows, FIELDS).where("vec_id < 400"), integer_scores(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = topk.top_k(frame, "vec_id % 100 = 7").orderBy("query_id", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [[int(i) for i in np.lexsort((np.arange(400), -score[q])) if i != q][:5] for q in range(7, 400, 100)]
    assert [r["vec_id"] for r in got] == sum(want, [])


def test_top_k_is_exact(spark, small_shards):
    data, _, rows = vectors()
    frame = spark.createDataFrame(rows, FIELDS)
    score, want = integer_scores(data), []
    for q in range(0, 400, 50):
        order = [i for i in np.lexsort((np.arange(400), -score[q])) if i != q][:5]
        want += [(q, rank, int(i), int(score[q, i])) for rank, i in enumerate(order, 1)]
    zero = [(2000, [0.0] * 22, 1, "x", 1, "y")]  # a zero vector takes part: its scores are 0
    assert sorted(tuple(r) for r in topk.top_k(frame, "vec_id % 50 = 0").collect()) == want
    assert topk.top_k(spark.createDataFrame(rows + zero, FIELDS), "vec_id = 2000").where("score = 0").count() == 5
    few = topk.top_k(frame.where("vec_id in (50, 51, 52)"), "vec_id = 50", k=5).collect()
    assert len(few) == 2
    assert topk.top_k(frame.limit(0), "true").count() == 0 and topk.top_k(frame, "vec_id = 99999").count() == 0
    assert topk.top_k(frame, "cast(null as boolean)").count() == 0


def test_segment_statistics_bound_the_product():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 16, 22, 64):
        x = rng.integers(-200, 200, (50, dim))
        product = (x @ x.T).astype(float)
        for length in topk.SEGMENTS:
            stats = topk.segment_statistics(x, length)
            assert (stats @ stats.T >= product - 1e-6).all()


def test_products_are_exact_beyond_doubles():
    index = topk.SegmentIndex(np.arange(2), np.array([[2**27, 1], [2**27, 3]]))
    assert index.products(np.arange(2), np.array([2**27 - 1, 7])).tolist() == [2**27 * (2**27 - 1) + 7, 2**27 * (2**27 - 1) + 21]


def test_four_russians_scores():
    rng = np.random.default_rng(4)
    for dim, spread in ((1, 3), (8, 1), (13, 140), (64, 300), (9, 2**27)):
        x, a = rng.integers(-spread, spread, (70, dim)), rng.integers(-spread, spread, (5, dim))
        shard = negatives.Shard(np.arange(70), x, np.zeros(70, np.int64))
        assert (shard.score(a, 0, 70) == a @ x.T).all()
    positive = rng.integers(0, 9, (6, 4))
    assert (negatives.Shard(np.arange(6), positive, np.zeros(6, np.int64)).score(positive, 2, 5) == positive @ positive[2:5].T).all()


def test_hard_negatives_are_exact(spark, small_shards, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "ROWS", 32)
    data, labels, rows = vectors()
    rows += [(3000, data[0].tolist(), None, "x", 1, "y")]
    score, want = integer_scores(data), []
    for a in range(0, 400, 50):
        order = [int(i) for i in np.lexsort((np.arange(400), -score[a]))]
        for p in [i for i in order if i != a and labels[i] == labels[a]][:5]:
            fits = [i for i in order if labels[i] != labels[a] and 50 * score[a, p] <= 100 * score[a, i] <= 95 * score[a, p]]
            want += [(a, p, rank, i, int(score[a, p]), int(score[a, i])) for rank, i in enumerate(fits[:3], 1)]
    frame = spark.createDataFrame(rows, FIELDS)
    assert sorted(tuple(r) for r in negatives.hard_negatives(frame, "vec_id % 50 = 0").collect()) == sorted(want)
    alone = frame.where("label = 1 or label is null")
    assert negatives.hard_negatives(alone, "vec_id % 50 = 0").count() == 0
    assert negatives.hard_negatives(frame.limit(0), "true").count() == 0
    assert negatives.hard_negatives(frame.where(F.col("vec_id") == 50), "true").count() == 0
