"""Polygons, irregular sites, kernel warps, terrain edges and statistics by the day."""

from __future__ import annotations

import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.catalog import load_all
from emberframe.operators import burn, nearest, pairing, regions, resample, states, stencil, strips, tiles
from emberframe.session import scratch_path
from emberframe.sources import day_store

QUERIES, _ = load_all()


def bspline(t):
    a = abs(t)
    return (4 - 6 * a * a + 3 * a**3) / 6 if a < 1 else (2 - a) ** 3 / 6 if a < 2 else 0.0


@pytest.mark.parametrize("scale", [(1.0, 1.0), (2.5, 1.5)])
def test_kernel_warp_by_hand(spark, scale):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(20, 150))
    grid[rng.random(grid.shape) < 0.2] = np.nan
    cells = [(x, y, float(grid[y, x])) for y in range(20) for x in range(150)]
    aims = [(i, float(rng.uniform(-6, 155)), float(rng.uniform(-5, 25))) for i in range(300)] + [(300, 63.0, 4.0), (301, 64.0, 5.0), (302, 1e6, 3.0), (303, None, 1.0)]
    source = spark.createDataFrame(cells, "ix int, iy int, v double")
    targets = spark.createDataFrame(aims, "id int, a double, b double")
    got = {r["id"]: r["v"] for r in resample.kernel_warp(targets, source, F.col("a"), F.col("b"), scale=scale).collect()}
    assert len(got) == len(aims)
    for i, a, b in aims:
        total = weight = 0.0
        for x in range(150) if a is not None else ():
            wx = bspline((x - a) / scale[0])
            for y in range(20) if wx else ():
                if not math.isnan(grid[y, x]):
                    w = wx * bspline((y - b) / scale[1])
                    total, weight = total + w * grid[y, x], weight + w
        assert got[i] is None if weight <= 1e-9 else abs(got[i] - total / weight) < 1e-9


def test_weights_sum_to_one_where_data_is_missing(spark):
    flat = spark.range(100).select((F.col("id") % 10).alias("ix"), F.floor(F.col("id") / 10).alias("iy"), F.when(F.col("id") % 7 != 0, 3.5).alias("v"))
    targets = spark.range(200).select("id", (F.col("id") / 21).alias("a"), (F.col("id") % 9 + 0.3).alias("b"))
    assert resample.kernel_warp(targets, flat, F.col("a"), F.col("b")).where("abs(v - 3.5) < 1e-12").count() == 200


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                odd = not odd
    return odd


REGIONS = {
    "a": [[(0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (3.0, 1.5), (0.0, 5.0)], [(1.0, 0.5), (2.0, 0.5), (1.5, 1.0)]],  # concave, with a hole
    "b": [[(5.0, 4.0), (9.0, 4.0), (9.0, 8.0), (5.0, 8.0)], [(6.0, 5.0), (8.0, 5.0), (8.0, 7.0), (6.0, 7.0)], [(6.5, 5.5), (7.5, 5.5), (7.0, 6.5)]],
    "c": [[(-5.0, -5.0), (-4.97, -5.0), (-4.97, -4.0)]],  # thinner than a cell
}


@pytest.mark.parametrize("cell", [0.5, 0.73, 20.0])
def test_points_in_polygons(spark, cell):
    vertices = [(name, i, j, *p) for name, rings in REGIONS.items() for i, ring in enumerate(rings) for j, p in enumerate(ring)]
    rng = np.random.default_rng(2)
    points = [(float(x), float(y)) for x, y in rng.uniform(-6, 10, (1500, 2))] + [(x / 2, y / 2) for x in range(-11, 20) for y in range(-11, 18)]
    frame = spark.createDataFrame(points + [(None, 1.0)], "lon double, lat double")
    index = regions.index_regions(spark.createDataFrame(vertices, "name string, ring int, seq int, lon double, lat double"), cell)
    out = regions.locate_in_regions(frame, index, cell)
    got = {(r["lon"], r["lat"]): r["region"] for r in out.collect()}
    assert out.count() == len(points) + 1 and got[None, 1.0] is None
    for x, y in points:
        assert got[x, y] == min((name for name, rings in REGIONS.items() if inside(rings, x, y)), default=None), (x, y)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_points_on_slanted_edges(spark):
    """Points on an edge up to rounding: the cells answer as the ray against all edges does, wherever the edge leaves the cell."""
    ring = [(-125.0, 55.0), (-121.5, 55.0), (-121.5, 56.4), (-122.6, 56.9), (-122.0, 57.2), (-123.0, 58.0), (-125.0, 58.0)]
    hole = [(-123.9, 56.2), (-123.2, 56.2), (-123.2, 57.0), (-123.6, 56.45), (-123.9, 57.0)]
    points = []
    for (ax, ay), (bx, by) in [pair for r in (ring, hole) for pair in zip(r, r[1:] + r[:1])]:
        for i in range(801):
            y = ay + (by - ay) * i / 800
            x = ax + (y - ay) * (bx - ax) / (by - ay) if ay != by else ax + (bx - ax) * i / 800
            points += [(x, y), (float(np.nextafter(x, 0)), y), (float(np.nextafter(x, -200)), y), (x, float(np.nextafter(y, 0)))]
    vertices = [("a", i, j, *p) for i, r in enumerate((ring, hole)) for j, p in enumerate(r)]
    index = regions.index_regions(spark.createDataFrame(vertices, "name string, ring int, seq int, lon double, lat double"), 0.25)
    out = regions.locate_in_regions(spark.createDataFrame(points, "lon double, lat double"), index, 0.25)
    wrong = [p for p in out.collect() if (p["region"] == "a") != inside((ring, hole), p["lon"], p["lat"])]
    assert not wrong


def test_footprints_against_boxes(spark):
    day = "date'2020-06-01'"
    boxes = spark.sql(f"SELECT 't' AS tile, 0e0 AS min_lon, 1e0 AS max_lon, 0e0 AS min_lat, 1e0 AS max_lat, {day} AS first_date, {day} AS last_date")
    shapes = {
        1: [(0.4, 0.4), (0.6, 0.4), (0.5, 0.6)],  # within the box
        2: [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)],  # around it
        3: [(0.9, 2.0), (2.0, 0.9), (2.0, 2.0)],  # its bounding box meets the box, it does not
        4: [(0.5, 1.6), (1.6, 0.5), (2.0, 2.0)],  # likewise, from nearer
        5: [(0.4, -3.0), (0.6, -3.0), (0.6, 3.0), (0.4, 3.0)],  # crosses it
    }
    rows = [(s, j, *p) for s, ring in shapes.items() for j, p in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "scene_id int, seq int, lon double, lat double").withColumn("acq_date", F.expr(day))
    found = regions.search_footprints(boxes, vertices, buffer_deg=0.0)
    assert sorted(r["scene_id"] for r in found.collect()) == [1, 2, 5]


def test_nearest_site_against_brute_force(spark):
    rng = np.random.default_rng(3)
    sites = np.vstack([rng.normal(0, 0.01, (300, 2)), rng.uniform(-50, 50, (12, 2)), [[-60.0, -60.0], [60.0, 60.0]]]).round(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(sites)] + [(900, float(sites[5][0]), float(sites[5][1])), (None, 0.0, 0.0), (901, None, 1.0)]
    asked = np.vstack([rng.uniform(-55, 55, (150, 2)), rng.normal(0, 0.02, (100, 2)), sites[:20]])
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(asked)] + [(500, 99.0, 0.0), (501, None, 0.0)]
    frame, table = spark.createDataFrame(points, "id int, lon double, lat double"), spark.createDataFrame(rows, "site int, lon double, lat double")
    for cell in (None, 0.5):
        got = {r["id"]: (r["site"], r["distance"]) for r in nearest.nearest_site(frame, table, "id", "site", cell=cell).collect()}
        assert got[500] == got[501] == (None, None) and len(got) == len(points)
        for i, (x, y) in enumerate(asked):
            d, s = min((math.hypot(x - r[1], y - r[2]), r[0]) for r in rows if None not in r)
            assert got[i][0] == s and abs(got[i][1] - d) < 1e-12
    assert nearest.nearest_site(frame, table.limit(0), "id", "site").where("site IS NULL AND distance IS NULL").count() == len(points)


def test_nearest_site_in_several_lists(spark, monkeypatch):
    """Points are read once, and a cell's list of sites may come in several parts."""
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(0, 0.1, (80, 2)), rng.uniform(-9, 9, (20, 2))]).round(1))]
    asked = np.vstack([rng.normal(0, 0.3, (60, 2)), rng.uniform(-9, 9, (60, 2))]).round(1)
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        reads.add(1)
        return v

    frame = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "id int, x double, lat double")
    frame = frame.withColumn("lon", counted.asNondeterministic()("x"))
    table = spark.createDataFrame(rows, "site int, lon double, lat double")
    low, high = (np.array([r[1:] for r in rows]).__getattribute__(f)(axis=0) for f in ("min", "max"))
    for size in (1024, 3):
        monkeypatch.setattr(nearest, "SITES_PER_LIST", size, raising=False)
        before = reads.value
        got = {r["id"]: (r["site"], r["distance"]) for r in nearest.nearest_site(frame, table, "id", "site", cell=2.0).collect()}
        assert reads.value - before == len(asked) == len(got)
        for i, p in enumerate(asked):
            want = min((math.hypot(p[0] - r[1], p[1] - r[2]), r[0]) for r in rows)
            want = (want[1], want[0]) if (low <= p).all() and (p <= high).all() else (None, None)
            assert got[i][0] == want[0] and (want[0] is None or abs(got[i][1] - want[1]) < 1e-12)


def test_terrain_edges_are_extrapolated(spark):
    height = lambda y, x: 100.0 - 9.0 * y + 18.0 * x
    rows = [("t", y, x, height(y, x)) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "tile string, pixel_y int, pixel_x int, dem double")
    got = {(r["pixel_y"], r["pixel_x"]): r for r in stencil.slope_aspect(df, "dem", ("tile",), 90.0, 4).collect()}
    whole = np.degrees(np.arctan(np.hypot(0.1, 0.2)))
    for y in range(4):
        for x in range(1, 3):  # a plane keeps its slope in every row, edges included
            assert abs(got[y, x]["slope"] - whole) < 1e-9
    for y in (1, 2):
        assert abs(got[y, 0]["slope"] - whole) < 1e-9 and abs(got[y, 3]["slope"] - whole) < 1e-9
    # In a corner the column outside repeats the edge, so the fall to the east counts half.
    assert abs(got[0, 0]["slope"] - np.degrees(np.arctan(np.hypot(0.1, 0.1)))) < 1e-9
    hole = df.withColumn("dem", F.when(~((F.col("pixel_y") == 2) & (F.col("pixel_x") == 2)), F.col("dem")))
    near = stencil.slope_aspect(hole, "dem", ("tile",), 90.0, 4).where("pixel_y = 1 AND pixel_x = 1").first()
    east = (height(0, 2) + 2 * height(1, 2) + height(1, 1)) - (height(0, 0) + 2 * height(1, 0) + height(2, 0))
    south = (height(2, 0) + 2 * height(2, 1) + height(1, 1)) - (height(0, 0) + 2 * height(0, 1) + height(0, 2))
    assert abs(near["slope"] - np.degrees(np.arctan(np.hypot(east, south) / 720))) < 1e-9


def test_states_merge_to_one_pass(spark):
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.normal(1e6, 1, 500), rng.lognormal(0, 4, 500), -rng.lognormal(0, 4, 300), [0.0] * 20])
    rows = [(int(i % 7), float(v), float("inf") if i == 3 else float(i)) for i, v in enumerate(data)] + [(2, float("nan"), None), (9, None, None)]
    pixels = spark.createDataFrame(rows, "day int, a double, b double")
    by_day = states.day_states(pixels, ["a", "b"])
    one = {r["feature"]: r for r in states.summary(states.merge_states(by_day.drop("day"), "feature")).collect()}
    got, exact = one["a"], np.sort(data)
    assert got["count"] == len(data) and got["min"] == exact[0] and got["max"] == exact[-1]
    assert abs(got["mean"] - data.mean()) < 1e-9 * abs(data).max() and abs(got["std"] - data.std()) < 1e-9 * data.std() + 1e-7
    assert one["b"]["count"] == len(data) - 1
    merged = states.merge_states(by_day.drop("day"), "feature").where("feature = 'a'")
    for q in (0.0, 0.1, 0.35, 0.5, 0.9, 1.0):
        value = merged.select(states.quantile(q).alias("v")).first()["v"]
        true = exact[math.floor(q * (len(data) - 1))]
        assert abs(value - true) <= 0.0100001 * abs(true) + 1e-9


def test_a_day_is_added_without_the_others(spark):
    pixels = spark.range(3000).select((F.col("id") % 5).cast("int").alias("day"), F.sin("id").alias("a"))
    path = scratch_path(spark, "states")
    merged = lambda: states.summary(states.merge_states(day_store.read_days(spark, path), "feature")).first()
    with pytest.raises(ValueError):
        day_store.read_days(spark, path)

    def add(rows, days, broken=False):
        todo = day_store.pending_days(days, path)
        day_store.write_days(states.day_states(rows.join(todo, "day", "left_semi"), ["a"]), path)
        if not broken:
            day_store.commit_days(todo, path)

    days = pixels.select("day").distinct()
    add(pixels.where("day < 3"), days.where("day < 3"))
    add(pixels.where("day = 3"), days.where("day = 3"), broken=True)
    assert merged()["count"] == pixels.where("day < 3").count()  # written, not recorded: not read
    assert sorted(r["day"] for r in day_store.pending_days(days, path).collect()) == [3, 4]
    add(pixels.where("day >= 3"), days)  # only the pixels of the pending days are given
    whole = states.summary(states.merge_states(states.day_states(pixels, ["a"]).drop("day"), "feature")).first()
    assert merged() == whole and day_store.pending_days(days, path).isEmpty()
    add(pixels, days)  # nothing is pending: nothing changes
    assert merged() == whole


def test_strips_hold_full_sparse_and_missing_rows(spark):
    rng = np.random.default_rng(6)
    want = np.full((9, 9), -1)
    rows = []
    for y in range(9):
        for x in {0: range(9), 3: (0, 8), 4: (5,), 8: range(9)}.get(y, ()):
            want[y, x] = rng.integers(1, 90)
            rows.append((1, y, x, int(want[y, x])))
    rows[2] = (*rows[2][:3], None)
    want[0, 2] = -1
    cells = spark.createDataFrame(rows, "t int, pixel_y int, pixel_x int, v int").repartition(4)
    days = spark.createDataFrame([(1,), (2,)], "t int")
    filled = strips.fill(strips.scaffold(days, ("t",), 9), cells, {"v": -1}, ("t",), 9)
    got = {r["t"]: r["v"] for r in strips.pack(filled, ["v"], ("t",)).collect()}
    assert got == {1: want.ravel().tolist(), 2: [-1] * 81}
    for radius in (1, 2, 12):
        around = strips.window(filled, "v", "most", F.greatest, -5, radius, ("t",)).where("t = 1")
        most = np.array(strips.pack(around, ["most"], ("t",)).first()["most"]).reshape(9, 9)
        for y in range(9):
            for x in range(9):
                part = want[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
                assert most[y, x] == part.max()
    assert strips.pack(strips.fill(strips.scaffold(days.limit(0), ("t",), 9), cells.limit(0), {"v": -1}, ("t",), 9), ["v"], ("t",)).count() == 0


def test_patches_of_strips_are_those_of_cells(spark):
    rng = np.random.default_rng(7)
    rows = [(t, y, x, float(v), float(w)) for t in (1, 2) for y in range(6) for x in range(6) for v, w in [rng.normal(size=2)]]
    rows[5], rows[9] = (*rows[5][:3], float("nan"), 1.0), (*rows[9][:3], float("inf"), float("-inf"))
    cells = spark.createDataFrame(rows, "t int, pixel_y int, pixel_x int, a double, b double")
    filled = strips.fill(strips.scaffold(cells.select("t").distinct(), ("t",), 6), cells, {"a": 0.0, "b": 0.0}, ("t",), 6)
    for patch in (1, 3, 5):
        made = strips.patches(filled, ["a", "b"], patch, ("t",))
        long = made.select("t", "pixel_y", F.posexplode("features").alias("pixel_x", "features"))
        got = {tuple(r[:3]): r["features"] for r in long.select("t", "pixel_y", "pixel_x", "features").collect()}
        whole = stencil.extract_patches(cells, ["a", "b"], patch, ("t",)).select("t", "pixel_y", "pixel_x", "features")
        assert got == {tuple(r[:3]): r["features"] for r in whole.collect()}
    with pytest.raises(ValueError):
        strips.patches(filled, ["a"], 2, ("t",))


def test_cells_of_pairs_are_history_and_growth(spark):
    """Fires that burn a pixel again, are listed twice a day or not every day, never burn, and pairs across blocks of days."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        dob = int(rng.integers(1, 30))
        day = None if i % 90 == 0 else dob + int(rng.integers(-12, 3)) if i % 3 else dob - 2
        rows.append((2020, int(rng.integers(0, 2)), -1, f"f{i % 6}", day, dob, int(rng.integers(0, 8)), int(rng.integers(0, 8)), i, float(i % 6 > 0 and i % 4 > 0)))
    rows += [(2021, 0, 0, "g", 1, 7, 2, 2, 1000, 1.0), (2021, 0, 0, "h", 1, 8, 2, 3, 1001, 1.0), (2021, 0, 0, "h", 1, 20, 1, 1, 1002, 1.0)]
    schema = "year int, tile_col int, tile_row int, id string, fireday int, dob int, pixel_y int, pixel_x int, row_seq bigint, cumuarea double"
    points = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0.0) for c in ("lon", "lat", "firearea")}).repartition(5)
    table = burn.burn_table(points)
    fires, masks = tiles.tile_fires(table), burn.masks_of(table)
    pairs = pairing.next_day_pairs(pairing.tile_days(fires)).select(*tiles.TILE_DAY)
    current = burn.history_cells(fires.join(pairs, list(tiles.TILE_DAY), "left_semi"), masks)
    cells = [*tiles.TILE_DAY, "pixel_y", "pixel_x"]
    got = burn.pair_cells(burn.fire_lists(points), grid=8)
    named = got.where("pixel_x IS NULL").select(*tiles.TILE_DAY, "pixel_y").collect()
    assert sorted(named) == sorted((*p, y) for p in pairs.collect() for y in range(8)) and len(named) > 100
    held = got.join(pairs, list(tiles.TILE_DAY), "left_semi").where("pixel_x IS NOT NULL")
    burned = held.where("first_fireday IS NOT NULL")
    assert sorted(burned.select(*cells, "first_fireday").collect()) == sorted(current.select(*cells, "first_fireday").collect())
    assert sorted(held.where("grown").select(*cells).collect()) == sorted(burn.new_growth(fires, masks, pairs).select(*cells).collect())
    assert held.where("grown").count() > 50


def test_gathered_strips_are_filled_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(t, y, int(x), int(rng.integers(1, 90))) for t in (1, 2) for y, n in ((0, 9), (3, 2), (4, 1), (8, 9)) for x in rng.permutation(9)[:n]]
    cells = spark.createDataFrame(rows, "t int, pixel_y int, pixel_x int, v int").repartition(4)
    names = strips.scaffold(spark.createDataFrame([(1,), (3,)], "t int"), ("t",), 9)
    filled = strips.fill(names, cells, {"v": 0}, ("t",), 9).select("t", "pixel_y", "v")
    channels = {"v": lambda w: F.shiftright(w, 1).cast("int"), "odd": lambda w: F.getbit(w, F.lit(0))}
    word = F.col("v").cast("bigint") * 2 + F.col("v") % 2
    got = strips.gather(cells.unionByName(names, allowMissingColumns=True), word, channels, ("t",), 9)
    assert sorted(got.select("t", "pixel_y", "v").collect()) == sorted(filled.collect())
    assert all(r["odd"] == [v % 2 for v in r["v"]] for r in got.collect())


@pytest.mark.skipif(not pathlib.Path("/root/testdata/sf0.001").exists(), reason="needs the given tables")
def test_strip_samples_shuffle_lists_only(spark):
    """Strips are made where the lists of their fires lie: one exchange, of lists, and no join that could build or spill strips."""
    plan = QUERIES["e2_strip_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
