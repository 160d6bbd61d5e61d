"""Queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import (
    chat, lm, near, negatives, neighbours, packing, passages, pieces, repair, rules, substrings, topk, warc,
)
from emberframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence of 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One WARC record per page, written and read back."""
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    records = warc.read(spark, folder).where("kind = 'record'")
    return records.select(
        warc.key_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"),
    )


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    judged, _ = rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.STATS, "base_failed", "kept")


@query("op9_chat_prefix_targets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text and its examples."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    formatted = chat.format_conversations(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    )
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    whole = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).select(
        F.col("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    replies = chat.expand_prefix_targets(formatted).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("position", chat.unescape(F.col("reply")).alias("reply")))).alias("replies"),
        F.sum(F.crc32(F.col("context").cast("binary"))).alias("contexts"),
    ).select("conv_id", F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("trained"), "contexts")
    trained = F.coalesce("trained", F.lit(""))
    return whole.join(replies, whole["conv_id"].eqNullSafe(replies["conv_id"]), "left").select(
        whole["conv_id"], "n_turns", "turns_sha256", F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"), "formatted_chars", F.coalesce("contexts", F.lit(0)).alias("contexts_crc32"),
    )


@query("op10_lsh_forest")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.75."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_substring_ranks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 100-byte deduplication removes from every document."""
    return substrings.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op2_passages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document shares with an earlier one."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_multi_index_hashing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0").select("query_id", "rank", "vec_id", "score")


def _repair_sql() -> str:
    """The cheapest repair as a recursion over the rows of all conversations: per state (e nothing yet, s, ..u, ..a) the least
    (cost, audit)."""
    add = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}}"
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    never = 1_000_000_000
    reroled = f"(CASE WHEN dead THEN {never} ELSE 3 + surcharge END)"
    kept = lambda initial: f"(CASE WHEN NOT dead AND initial = '{initial}' THEN surcharge ELSE {never} END)"
    to_user = [add(x, cost, letter) for x in "esa" for cost, letter in ((reroled, "R"), (kept("u"), "K"))]
    inserted = f"""
      SELECT conv_id, i, e, s, u, {least("a", add("u", 3, "I"))} AS a
      FROM (SELECT conv_id, i, e, s, a, {least("u", add("e", 3, "I"), add("s", 3, "I"), add("a", 3, "I"))} AS u FROM stepped)"""
    step = f"""
      SELECT dp.conv_id, dp.i + 1 AS i, {add("e", 4, "D")} AS e,
             {least(add("s", 4, "D"), add("e", kept("s"), "K"))} AS s, {least(add("u", 4, "D"), *to_user)} AS u,
             {least(add("a", 4, "D"), add("u", reroled, "R"), add("u", kept("a"), "K"))} AS a
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1"""
    none = f"{{'c': {never}, 'a': ''}}"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                        lambda c: CAST(ascii(c) AS BIGINT)) AS key FROM conversations),
c AS (
  SELECT *, xor(list_reduce(key, lambda crc, byte: list_reduce(range(8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295),
                4294967295) % 20 AS damage FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE damage <> 0),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         row_number() OVER o AS i, left(role, 1) AS initial,
         CASE WHEN row_number() OVER o > 1 THEN coalesce(lag(left(role, 1)) OVER o, '') || left(role, 1) END AS pair
  FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
r AS (SELECT *, fault IN (1, 2) AS dead, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS surcharge FROM f),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS e, {{'c': CAST({never} AS BIGINT), 'a': ''}} AS s,
         {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS u, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS a FROM n
  UNION ALL
  SELECT * FROM (WITH stepped AS ({step}) {inserted})),
b AS (
  SELECT n.*, {least("e", "a")} AS best FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i),
w AS (SELECT conv_id, best.a AS audit, unnest(range(1, len(best.a) + 1)) AS p FROM b),
x AS (
  SELECT w.conv_id, p, audit[p] AS letter, r.role, r.text, r.initial,
         row_number() OVER (PARTITION BY w.conv_id ORDER BY p) AS q
  FROM w LEFT JOIN r ON audit[p] <> 'I' AND r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = p - len(regexp_replace(audit[:p], '[^I]', '', 'g'))
  WHERE audit[p] <> 'D'),
y AS (SELECT *, coalesce(max(CASE WHEN q = 1 AND letter = 'K' AND initial = 's' THEN 1 END) OVER (PARTITION BY conv_id), 0) AS opened FROM x),
z AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY q)) AS digest FROM y GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_branch_and_bound", oracle=_repair_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    plans, repaired = repair.repair(repair.damage(table(spark, sf_dir, "conversations")), present="present")
    hashed = repair.digests(repaired).withColumnRenamed("conv_id", "id")
    return plans.join(hashed, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: Rows of ``embeddings`` that take part in integer scores, with their integer components.
_INTEGERS = """
SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains([x IS NULL OR NOT isfinite(x) FOR x IN embedding], true)
"""


@query("op12_segment_bounds", oracle=f"""
WITH e AS ({_INTEGERS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e AS q JOIN e AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@query("op13_four_russians", oracle=f"""
WITH e AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label
           FROM ({_INTEGERS}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM e AS a JOIN e AS c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives of each of five positives of every vector whose id is divisible by 50."""
    relabelled = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END")
    )
    return negatives.hard_negatives(relabelled, "vec_id % 50 = 0")


@query("op6_stupid_backoff", oracle="""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (SELECT count(*) AS total FROM t),
u AS (SELECT b, count(*) AS c FROM t GROUP BY b),
p AS (SELECT a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY a, b),
s AS (SELECT t.doc_id, t.a IS NOT NULL AND p.c < 2 AS backed,
             CASE WHEN t.a IS NULL THEN ln(u.c / n.total) WHEN p.c >= 2 THEN ln(p.c / x.c) ELSE ln(0.4) + ln(u.c / n.total) END AS v
      FROM t CROSS JOIN n JOIN u ON u.b = t.b LEFT JOIN p ON p.a = t.a AND p.b = t.b LEFT JOIN u AS x ON x.b = t.a)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(sum(v), 0.0), 4) AS log_score,
       CAST(coalesce(sum(CAST(backed AS BIGINT)), 0) AS BIGINT) AS n_backoff
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, len(d.w)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram stupid-backoff score of every document under the counts of all documents."""
    return lm.stupid_backoff(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


@query("op7_gumbel_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, and digests of the ids and of what they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model, samples=2, seed=1).withColumn("ids_crc32", F.crc32("ids"))
    return pieces.decode(encoded, model).select(
        "doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "gumbel", "inclusion",
        F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32("decoded").alias("decoded_crc32"),
    )


@query("pipeline", oracle=corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline on all documents."""
    return corpus_pipeline.run(spark, sf_dir)
