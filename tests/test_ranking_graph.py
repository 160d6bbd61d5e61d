"""Two-level ranks, quantiles, samples, components and splits against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions.probability import order_hash
from emberframe.operators import graph, metrics, model, ranking, sampling, split
from emberframe.operators.skew import salted_join
from emberframe.streaming import resume


def skewed_values(n: int = 4000, seed: int = 1) -> list[float]:
    """A third of the rows share one value, most of the rest crowd into a narrow range."""
    rng = random.Random(seed)
    return [0.25 if i % 3 == 0 else rng.random() * 1e-3 if i % 3 == 1 else round(rng.random(), 2) for i in range(n)]


def test_running_sums_with_ties_and_groups(spark):
    data = [(i % 2, v) for i, v in enumerate(skewed_values())]
    counted = spark.createDataFrame(data, "g int, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {(r["g"], r["v"]): r["c"] for r in ranking.running_sums(counted, "v", {"n": "c"}, True, 5, ["g"]).collect()}
    for g in (0, 1):
        values = sorted((v for k, v in data if k == g), reverse=True)
        for v in set(values):
            assert got[(g, v)] == sum(1 for x in values if x >= v)


def test_running_sums_refined_in_levels(spark, monkeypatch):
    monkeypatch.setattr(ranking, "LEVEL_BITS", 2)
    data = [(i % 2, v) for i, v in enumerate(skewed_values())]
    counted = spark.createDataFrame(data, "g int, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    buckets = ranking._with_range_bucket(counted, "v", 5, ["g"]).groupBy("g", "_bucket").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    ).orderBy("g", "_bucket").collect()
    assert len(buckets) > 40 and max(r["n"] for r in buckets) < 200
    assert all(a["high"] < b["low"] for a, b in zip(buckets, buckets[1:]) if a["g"] == b["g"])
    got = {(r["g"], r["v"]): r["c"] for r in ranking.running_sums(counted, "v", {"n": "c"}, True, 5, ["g"]).collect()}
    for g in (0, 1):
        values = np.array([v for k, v in data if k == g])
        assert all(got[(g, v)] == (values >= v).sum() for v in set(values.tolist()))


def test_exact_quantiles(spark):
    values = skewed_values(3001)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = (0.0, 0.1, 0.5, 0.8, 0.95, 1.0)
    assert np.allclose(ranking.exact_quantiles(df, "v", probs).first()["q"], np.quantile(values, probs), atol=1e-12)


def test_hash_sample_equals_a_window(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    order = order_hash(42, F.col("id"))
    quota = F.when(F.col("label") == 1, 700).otherwise(5000)
    got = {r["id"] for r in ranking.take_by_hash(df, ["label"], order, ["id"], quota, digits=2).collect()}
    full = ranking.rank_by_hash(df, ["label"], order, ["id"], digits=2)
    assert got == {r["id"] for r in full.where((F.col("label") == 0) | (F.col("hash_rank") <= 700)).collect()}
    assert len(got) == 700 + 2000
    for few in (0, 1, 700, 1000):
        some = ranking.take_by_hash(df, ["label"], order, ["id"], F.when(F.col("label") == 1, few).otherwise(0), digits=1)
        assert {r["id"] for r in some.collect()} == {r["id"] for r in full.where(f"label = 1 AND hash_rank <= {few}").collect()}
    ranks = sorted(r["hash_rank"] for r in full.where("label = 1").collect())
    assert ranks == list(range(1, 1001))


def test_balanced_sample_needs_both_classes(spark):
    df = spark.range(10).select("id", F.lit(0).alias("label"))
    with pytest.raises(Exception, match="both classes"):
        sampling.balanced_sample(df, ["id"], 3).collect()


def brute_components(vertices, edges):
    parent = {v: v for v in vertices}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {v: root(v) for v in vertices}


def test_components_of_a_hub_a_chain_and_noise(spark):
    rng = random.Random(3)
    names = [f"f{i:04d}" for i in range(400)]
    hub = [("f0200", n) for n in names[201:330]]  # a third of the graph hangs on one vertex
    chain = [(names[i], names[i + 1]) for i in range(60)]
    noise = [tuple(rng.sample(names[100:200], 2)) for _ in range(60)]
    edges = hub + chain + noise
    rng.shuffle(edges)
    got = graph.connected_components(
        spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(edges, "u string, v string")
    )
    assert {r["id"]: r["super_id"] for r in got.collect()} == brute_components(names, edges)


def test_batches_of_edges_give_the_components_of_all(spark):
    rng = random.Random(11)
    names = [f"f{i:04d}" for i in range(300)]
    edges = [(names[150], n) for n in names[151:250]] + [tuple(rng.sample(names[:150], 2)) for _ in range(110)]
    rng.shuffle(edges)
    history = spark.createDataFrame([], "id string, super_id string")
    for part in range(3):
        labels = graph.current_labels(history)
        before = dict(labels.collect())
        batch = spark.createDataFrame(edges[part::3], "u string, v string")
        here = names[part * 100 : part * 100 + 100]
        delta = graph.extend_components(labels, spark.createDataFrame([(n,) for n in here], "id string"), batch)
        rows = [tuple(r) for r in delta.collect()]
        assert len({i for i, _ in rows}) == len(rows)
        assert all(before.get(i) != s for i, s in rows)  # nothing but what is new or has changed
        history = history.unionByName(spark.createDataFrame(rows, "id string, super_id string"))
    assert dict(graph.current_labels(history).collect()) == brute_components(names, edges)


def test_grouped_split_never_leaks(spark):
    rng = random.Random(5)
    rows, pts = [], []
    for f in range(240):
        tile = rng.randrange(120)
        for day in range(2):
            rows.append((2024, tile, 0, 100 + day, f"f{f:03d}", day + 1, f * 2 + day))
        pts.append((f"f{f:03d}", 50 + rng.random() * 5, -120 + rng.random() * 5))
        pts.append((f"f{f:03d}", 50 + rng.random() * 5, -120 + rng.random() * 5))
    fires = spark.createDataFrame(rows, "year int, tile_col int, tile_row int, dob int, id string, fireday int, first_seq bigint")
    members = graph.super_fires(fires).persist()
    stats = split.super_fire_stats(spark.createDataFrame(pts, "id string, lat double, lon double"), members)
    assigned = split.stratified_split(split.strata(split.size_and_place_bins(stats)))
    placed = split.split_fires(members, assigned).persist()
    assert placed.count() == 240 and placed.select("id").distinct().count() == 240
    assert split.leaks(fires, placed).count() == 0
    sizes = {r["split"]: r["count"] for r in assigned.groupBy("split").count().collect()}
    total = sum(sizes.values())
    assert abs(sizes["train"] / total - 0.7) < 0.06 and sizes["val"] > 0 and sizes["test"] > 0


def test_pr_summary_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(round(rng.random() ** 3, 2), int(rng.random() < 0.2)) for _ in range(800)]
    got = metrics.pr_summary(spark.createDataFrame(rows, "score double, label int")).first()
    pos = sum(y for _, y in rows)
    area = ap = 0.0
    recall, precision = 0.0, 1.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(y for s, y in rows if s >= t)
        n = sum(1 for s, _ in rows if s >= t)
        area += (tp / pos - recall) * (tp / n + precision) / 2
        ap += (tp / pos - recall) * tp / n
        recall, precision = tp / pos, tp / n
    assert abs(got["auc_pr"] - area) < 1e-12 and abs(got["average_precision"] - ap) < 1e-12
    one = metrics.pr_summary(spark.createDataFrame([(0.3, 1), (0.4, 1)], "score double, label int")).first()
    assert (one["auc_pr"], one["average_precision"]) == (0.0, 0.0)


def test_best_model_first_wins_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.7), ("c", 2, 0.7)], "name string, ord int, m double")
    assert metrics.best_of(df, "m", "ord", ["name"]).first()["name"] == "b"


def test_sweep_in_one_iteration_matches_single_fits(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3)) * [1.0, 2.0, 0.0]  # the last feature is constant
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] - 1)))).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "features array<double>, label int").repartition(5)
    got = model.train_sweep(df, [1.0, 8.0])
    for w, (coefficients, intercept) in got.items():
        single = model.train_logistic(df, w, max_iter=200)
        assert np.allclose(coefficients, single.coefficients.toArray(), atol=1e-4) and abs(intercept - single.intercept) < 1e-4
        slope = model.loss_gradient(df, w, coefficients, intercept).first()
        assert max(map(abs, [*slope["slopes"], slope["intercept"]])) < 1e-8


def test_sweep_of_separable_rows_one_class_and_none(spark):
    df = spark.createDataFrame([([float(v)], int(v > 0)) for v in range(-20, 20)], "features array<double>, label int")
    (w, b), = model.train_sweep(df, [2.0]).values()
    slope = model.loss_gradient(df, 2.0, w, b).first()
    assert w[0] > 0 and max(abs(slope["slopes"][0]), abs(slope["intercept"])) < 1e-8
    assert model.train_sweep(df.where("label = 1"), [1.0]) == {1.0: ([0.0], float("inf"))}
    with pytest.raises(ValueError):
        model.train_sweep(df.limit(0), [1.0])


def test_resume_retries_failures_only(spark):
    work = spark.createDataFrame([(1,), (2,), (3,)], "fire_id int")
    log = spark.createDataFrame([(1, 1, "success"), (2, 1, "success"), (2, 2, "failed")], "fire_id int, run int, status string")
    pending = resume.pending_work(work, log)
    assert sorted(r["fire_id"] for r in pending.collect()) == [2, 3]
    rows = resume.outcome_rows(pending, work.where("fire_id = 3"), run=3)
    after = resume.pending_work(work, log.unionByName(rows))
    assert [r["fire_id"] for r in after.collect()] == [3]


def test_result_does_not_depend_on_partitions(spark):
    values = [(v,) for v in skewed_values(1500)]
    df = spark.createDataFrame(values, "v double")
    want = ranking.exact_quantiles(df, "v", (0.5, 0.9)).first()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert ranking.exact_quantiles(df.repartition(5), "v", (0.5, 0.9)).first() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    """A thousand distinct values, one of them with most of the weight, in buckets of about fifty."""
    from emberframe.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 50)
    assert [ranking.bucket_bits(n) for n in (0, 1, 50, 51, 100, 101, 1000)] == [0, 0, 0, 1, 1, 2, 5]
    rows = [(float((7 * i) % 1000), 1_000_000 if i == 3 else 1) for i in range(1000)]
    got = ranking.running_sums(spark.createDataFrame(rows, "v double, n long").repartition(4), "v", {"n": "upto"}, descending=True)
    total, want = 0, {}
    for v, n in sorted(rows, reverse=True):
        total += n
        want[v] = total
    assert {r["v"]: r["upto"] for r in got.collect()} == want


def test_salted_side_is_never_broadcast(spark):
    """The planner takes a side repeated once per salt for as small as the side itself."""
    many = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    one = spark.range(3).selectExpr("id AS k", "id * 10 AS w")
    out = salted_join(many, one, ["k"], F.col("v"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert out.where("w = k * 10").count() == 100


def test_super_fires_link_tile_days(spark, monkeypatch):
    """Many fires on few tile-days: the graph has the tile-days, not the fires, and the labels are those of brute force."""
    rng = random.Random(5)
    rows = [(f"f{i}", 2020, i % 3, 0, 100 + rng.randrange(4), 1, i) for i in range(300)] + [("f1", 2020, 0, 0, 100, 2, 999), ("alone", 2020, 9, 9, 5, 1, 7), ("nowhere", 2020, None, 0, 5, 1, 8)]
    rows += [(f"m{i}", 2020, None, 1, 5, 1, i) for i in range(2)]  # without a tile they share nothing
    sizes, contract = [], graph.connected_components

    def counted(vertices, edges, *args, **options):
        sizes.append(edges.count())
        return contract(vertices, edges, *args, **options)

    monkeypatch.setattr(graph, "connected_components", counted)
    fires = spark.createDataFrame(rows, "id string, year int, tile_col int, tile_row int, dob int, fireday int, first_seq long")
    got = {r["id"]: r["super_id"] for r in graph.super_fires(fires).collect()}
    groups = [{i} for i in {r[0] for r in rows}]
    for day in {r[1:5] for r in rows if None not in r[1:5]}:
        here = {r[0] for r in rows if r[1:5] == day}
        joined = [g for g in groups if g & here]
        groups = [g for g in groups if not g & here] + [set().union(*joined)]
    assert got == {i: min(g) for g in groups for i in g}
    assert max(sizes) <= len({r[1:5] for r in rows})
