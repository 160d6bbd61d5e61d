"""WARC, chat formatting, vector search and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import chat, neighbours, warc
from emberframe.session import scratch_path

PAGES = [
    (3, "http://a/\r\nX: 1", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "u", ""), (5, "u", None), (4, "u", "WARC/1.1\r\nfake\r\n\r\n\x1f\r\n\r\n"),
    (7, "ü", "ü😀\n" * 2000), (1, None, "<p>one</p>"), (None, "n", "<p>one</p>"), (-8, "u", "unique"),
]


def expected(pages):
    first = {}
    for k, _, body in pages:
        if k is not None:
            first[body or ""] = min(k, first.get(body or "", k))
    out = []
    for k, _, body in pages:
        data = (body or "").encode()
        again = k is not None and first[body or ""] < k
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[body or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, compress):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, refers_to string, _key int").repartition(2)
    path = scratch_path(spark, "warc")
    warc.write(pages, path, compress=compress, records_per_file=3)
    found = warc.read(spark, path)
    assert found.where("kind = 'gap'").count() == 0
    got = found.select(warc.key_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.key_of(F.col("refers_to"))).collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)
    bodies = {bytes(r["payload"]).decode() for r in found.where("record_type = 'response'").collect()}
    assert bodies == {b or "" for _, _, b in PAGES}
    warc.write(pages.limit(0), path + "-none", compress=compress)
    assert warc.read(spark, path + "-none").count() == 0


def test_threshold_makes_small_payloads_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.first_holders(pages, key="page_id", payload="html", min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def _records(n, packed):
    raw = [warc.record(f"urn:record:{k}", f"page {k} ".encode() * 40, url="u") for k in range(n)]
    return [gzip.compress(r, mtime=0) for r in raw] if packed else raw


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_follows_damage(packed):
    parts = _records(6, packed)
    ids = lambda data: [x["warc-record-id"] for _, _, x in warc.salvage(data) if isinstance(x, dict)]
    name = lambda *ks: [f"<urn:record:{k}>" for k in ks]
    assert ids(b"".join(parts)) == name(*range(6))
    whole = b"".join(parts)
    at = len(parts[0]) + len(parts[1]) // 2
    flipped = bytearray(whole)
    flipped[at] ^= 0xFF
    assert ids(bytes(flipped)) == name(0, 2, 3, 4, 5)
    gaps = [(a, n) for a, n, x in warc.salvage(bytes(flipped)) if isinstance(x, str)]
    assert len(gaps) == 1 and gaps[0][0] <= at < gaps[0][0] + gaps[0][1] and gaps[0][0] == len(parts[0])
    junk = parts[0] + b"junk \x1f\x8b\x08 WARC/1.0 more" + b"".join(parts[1:])
    assert ids(junk) == name(*range(6))
    assert ids(whole[:-20]) == name(*range(5))
    assert ids(whole[30:]) == name(1, 2, 3, 4, 5)
    assert ids(b"") == [] and list(warc.salvage(b"nothing here"))[0][:2] == (0, 12)
    covered = sum(n for _, n, _ in warc.salvage(junk))
    assert covered == len(junk)


def test_a_wrong_length_does_not_hide_later_records():
    parts = _records(3, False)
    broken = parts[0].replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 9", 1)
    found = [x if isinstance(x, str) else x["warc-record-id"] for _, _, x in warc.salvage(broken + parts[1] + parts[2])]
    assert found[1:] == ["<urn:record:1>", "<urn:record:2>"] and "length" in found[0]
    member = gzip.compress(parts[0] + parts[1].replace(b"page", b"PAGE") + parts[2], mtime=0)
    found = [x if isinstance(x, str) else x["warc-record-id"] for _, _, x in warc.salvage(member)]
    assert found == ["<urn:record:0>", "block digest differs", "<urn:record:2>"]


def test_numbers_out_of_range_are_damage(spark):
    parts = _records(3, False)
    long_ = parts[0].replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: " + b"9" * 5000, 1)
    revisit = warc.record("urn:record:9", b"x", refers_to="urn:record:0").replace(b"\r\nContent-Length: 1\r\n\r\n", b"\r\nContent-Length: " + b"7" * 30 + b"\r\n\r\n")
    revisit = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", revisit)
    size = len(revisit) - revisit.index(b"HTTP/1.1") - 4
    revisit = re.sub(rb"msgtype=response\r\nContent-Length: \d+", b"msgtype=response\r\nContent-Length: %d" % size, revisit)
    folder = scratch_path(spark, "damaged")
    spark.createDataFrame([((long_ + parts[1] + revisit + parts[2])[:-4].decode(),)], "value string").write.option("lineSep", "\r\n\r\n").text(folder)
    got = sorted(warc.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["record_id"] or r["reason"] for r in got] == ["content length is out of range", "urn:record:1", "urn:record:9", "urn:record:2"]
    assert got[2]["payload_bytes"] is None and got[2]["record_type"] == "revisit"


def test_reading_is_linear_in_the_members():
    one = b"".join(gzip.compress(warc.record(f"urn:record:{k}", f"page {k}".encode()), mtime=0) for k in range(500))
    spent = []
    for times in (4, 40):
        start = time.process_time()
        assert sum(isinstance(x, dict) for _, _, x in warc.salvage(one * times)) == 500 * times
        spent.append(time.process_time() - start)
    assert spent[1] < 40 * spent[0]
    big = _records(1, True)[0] + gzip.compress(warc.record("urn:record:big", b"0123456789" * 100_000 + bytes(range(256)) * 999), mtime=0)
    assert [x["warc-record-id"] for _, _, x in warc.salvage(big)] == ["<urn:record:0>", "<urn:record:big>"]


def test_first_holders_with_clashing_columns(spark):
    rows = spark.createDataFrame([(3, "a", 1, 2, 9), (1, "a", 1, 2, 9), (2, "b", 1, 2, 9)], "page_id long, html string, _key int, _first0 int, refers_to int")
    got = {r["page_id"]: r["refers_to"] for r in warc.first_holders(rows, key="page_id", payload="html").collect()}
    assert got == {3: 1, 1: None, 2: None}


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi </s> <\\s>"), (1, 2, "assistant", "[INST] \\ [\\INST] <s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "only"), (3, 5, "assistant", "ß😀\n\n"), (3, 5, "assistant", "ß😀\n\n"), (3, None, None, "no role"), (None, 0, "user", "x"),
    (4, 1, "a[INST]b</s>", "[\\\\INST][[/INST]]<</s>>"), (4, 2, "assistant", "INST]"), (4, 3, "<s", "[INST"),
]


def test_chat_reads_back_and_trains_each_reply_once(spark):
    turns = spark.createDataFrame([(*c, 1, "y") for c in CHATS], "conv_id long, turn long, role string, text string, position int, formatted string")
    formatted = chat.format_conversations(turns)
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in formatted.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    want: dict = {}
    for conv, turn, role, text in sorted(CHATS, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or 0, c[2] or "", c[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == want
    whole = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    examples = chat.expand_prefix_targets(formatted).select("*", chat.unescape(F.col("reply")).alias("text")).collect()
    for conv, turns_ in want.items():
        mine = sorted((r for r in examples if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["text"] for r in mine] == [t for role, t in turns_ if role == "assistant"]
        for r in mine:
            assert whole[conv][: r["context_chars"]] == r["context"]
            assert whole[conv][r["context_chars"] : r["context_chars"] + r["target_chars"]] == r["reply"]
            assert r["context"].count("</s>") == r["position"]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_query_reads_every_context(spark, tmp_path):
    from emberframe.llm.queries import QUERIES

    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r["contexts_crc32"] for r in QUERIES["op9_chat_prefix_targets"](spark, str(tmp_path)).collect() if r["conv_id"] != -1}
    want = dict.fromkeys({c[0] for c in CHATS}, 0)
    for r in chat.expand_prefix_targets(chat.format_conversations(turns)).collect():
        want[r["conv_id"]] += zlib.crc32(r["context"].encode())
    assert got == want and any(want.values())


def _vectors(n=600, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))


def test_nearest_reaches_its_recall_with_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 16)
    data = _vectors()
    data[7] = data[11] = data[13]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(data)]
    odd = [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] + [1.0] * 23), (1060, [None] + [1.0] * 23), (1080, [1.0] * 5), (None, data[0].tolist()), (1100, [float("inf")] * 24)]
    frame = spark.createDataFrame(rows + [(i, v, "x", 1) for i, v in odd] + rows[:1], "vec_id long, embedding array<double>, v string, shard int")
    got = neighbours.nearest(frame, "vec_id % 20 = 0", k=10).collect()
    by_query: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    assert sorted(by_query) == list(range(0, 600, 20))
    hits = 0
    for q, found in by_query.items():
        score = (data * data[q]).sum(axis=1)
        assert [r["rank"] for r in found] == list(range(1, 11)) and q not in {r["vec_id"] for r in found}
        assert all(r["score"] == score[r["vec_id"]] for r in found)
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys)
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(600), -score))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(by_query)
    lonely = frame.where("vec_id < 60").unionByName(spark.createDataFrame([(400, (-5 * data[0] - 7 * data[1]).tolist(), "x", 1)], frame.schema))
    assert len([r for r in neighbours.nearest(lonely, "vec_id = 400", k=20, target=0.1).collect()]) == 20
    few = neighbours.nearest(frame.where("vec_id < 4"), "vec_id % 20 = 0", k=10).collect()
    assert [r["vec_id"] for r in few] and len(few) == 3
    assert neighbours.nearest(frame.limit(0), "true").count() == 0 and neighbours.nearest(frame, "vec_id = 999999").count() == 0


def test_multi_index_finds_every_code_in_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    index = neighbours.MultiIndex(codes)
    for radius in (0, 1, 3, 5, 8, 11, 14, 20, 32):
        for q in rng.integers(0, 256, (10, 4), dtype=np.uint8):
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert index.within(q, radius).tolist() == want.tolist()


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == columns
        path = scratch_path(spark, name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_queries_are_registered():
    from emberframe.llm.queries import ORACLES, QUERIES

    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(ORACLES) <= set(QUERIES)
