"""Stencils, imagery, weather, statistics and sample files against brute force."""

from __future__ import annotations

import datetime as dt
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions import provenance, values
from emberframe.operators import channels, metrics, quality, satellite, stats, stencil, weather
from emberframe.sources import samples

GRID = 10


def mask_frame(spark, mask):
    ys, xs = np.nonzero(mask)
    rows = [("t", int(y), int(x)) for y, x in zip(ys, xs)]
    return spark.createDataFrame(rows, "tile string, pixel_y int, pixel_x int")


def as_mask(df):
    out = np.zeros((GRID, GRID), dtype=bool)
    for r in df.collect():
        assert not out[r["pixel_y"], r["pixel_x"]]
        out[r["pixel_y"], r["pixel_x"]] = True
    return out


def morph(mask, agg, fill):
    padded = np.pad(mask.astype(float), 1, constant_values=fill)
    return agg(np.stack([padded[dy:dy + GRID, dx:dx + GRID] for dy in range(3) for dx in range(3)]), axis=0)


def closing(mask):
    return morph(morph(mask, np.max, -np.inf), np.min, np.inf)


@pytest.fixture(scope="module")
def mask():
    return np.random.default_rng(4).random((GRID, GRID)) < 0.45


def test_closing_sparse_and_dense(spark, mask):
    closed = as_mask(stencil.close_mask(mask_frame(spark, mask), ("tile",), GRID))
    assert (closed == (closing(mask) > 0)).all()
    assert (closed >= mask).all()
    assert (closing(closed) > 0).tolist() == closed.tolist()
    rows = [("t", y, x, float(mask[y, x]) * (1 + x)) for y in range(GRID) for x in range(GRID)]
    dense = spark.createDataFrame(rows, "tile string, pixel_y int, pixel_x int, v double")
    want = closing(np.array([r[3] for r in rows]).reshape(GRID, GRID))
    for r in stencil.close_dense(dense, "v", ("tile",)).collect():
        assert r["v"] == want[r["pixel_y"], r["pixel_x"]]


def small_background(mask, size):
    out, seen = mask.copy(), mask.copy()
    for start in zip(*np.nonzero(~mask)):
        if seen[start]:
            continue
        stack, part = [start], []
        seen[start] = True
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for dy, dx in stencil.CROSS:
                p = (y + dy, x + dx)
                if 0 <= p[0] < GRID and 0 <= p[1] < GRID and not seen[p]:
                    seen[p] = True
                    stack.append(p)
        if len(part) <= size:
            for p in part:
                out[p] = True
    return out


@pytest.mark.parametrize("size", [0, 1, 3])
def test_fill_holes(spark, mask, size):
    dense = mask | (np.random.default_rng(8).random(mask.shape) < 0.35)
    got = as_mask(stencil.fill_holes(mask_frame(spark, dense), ("tile",), size, GRID))
    assert (got == (small_background(dense, size) if size else dense)).all()


def test_patches_are_zero_padded_in_feature_order(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((GRID, GRID)), rng.random((GRID, GRID))
    a[3, 3] = np.nan
    rows = [("t", y, x, float(a[y, x]), float(b[y, x])) for y in range(GRID) for x in range(GRID)]
    df = spark.createDataFrame(rows, "tile string, pixel_y int, pixel_x int, a double, b double")
    out = stencil.extract_patches(df, ["a", "b"], 5, ("tile",)).collect()
    pad = [np.pad(np.nan_to_num(p), 2) for p in (a, b)]
    for r in out:
        y, x = r["pixel_y"], r["pixel_x"]
        want = np.concatenate([p[y:y + 5, x:x + 5].ravel() for p in pad])
        assert np.array_equal(np.array(r["features"]), want)
    with pytest.raises(ValueError):
        stencil.patch_columns(["a"], 2)


def test_a_stencil_shuffles_once(spark):
    df = spark.range(100).select(F.floor(F.col("id") / 1000).alias("tile"), (F.col("id") / 10).cast("int").alias("pixel_y"), (F.col("id") % 10).cast("int").alias("pixel_x"), F.col("id").cast("double").alias("v"))
    for out in (stencil.extract_patches(df, ["v"], 3, ("tile",)), stencil.close_dense(df, "v", ("tile",))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_flat_and_sloped_terrain(spark):
    rows = [("t", y, x, 100.0 - 9.0 * y) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "tile string, pixel_y int, pixel_x int, dem double")
    centre = stencil.slope_aspect(df, "dem", ("tile",), 90.0).where("pixel_y = 2 AND pixel_x = 2").first()
    assert abs(centre["slope"] - np.degrees(np.arctan(0.1))) < 1e-9 and abs(centre["aspect"] - 180.0) < 1e-9
    flat = stencil.slope_aspect(df.withColumn("dem", F.lit(5.0)), "dem", ("tile",), 90.0).first()
    assert flat["slope"] == 0.0 and flat["aspect"] == 0.0


def test_mosaic_tiers(spark):
    d = dt.date
    scenes = spark.createDataFrame(
        [("a", 1, d(2024, 6, 10), 55.0), ("b", 1, d(2024, 6, 10), 10.0), ("c", 1, d(2024, 6, 1), 30.0), ("e", 1, d(2024, 6, 12), 95.0), ("z", 1, d(2024, 6, 14), 5.0)],
        "scene_id string, tile_no int, acq_date date, cloud_cover double",
    )
    px = [("a", "B02", 0, 7), ("a", "B02", 1, 8), ("b", "B02", 0, 5), ("b", "B02", 1, None), ("c", "B02", 0, 1), ("c", "B02", 1, 2), ("e", "B02", 0, 3), ("e", "B02", 1, 3), ("z", "B02", 0, 0), ("z", "B02", 1, 0)]
    px += [(s, "SCL", p, None) for s in "abcez" for p in (0, 1)]
    pixels = spark.createDataFrame(px, "scene_id string, band string, pixel int, value int")
    mosaic = satellite.daily_mosaic(scenes, pixels)
    day = {r["pixel"]: r["value"] for r in mosaic.where("acq_date = '2024-06-10' AND band = 'B02'").collect()}
    assert day == {0: 5, 1: 8}  # clearest scene first, gaps from the next
    accepted = satellite.accepted_days(mosaic)
    tiers = {r["acq_date"].day: r["tier"] for r in accepted.collect()}
    assert tiers == {10: 2, 1: 0, 12: 6}  # all zeros on the 14th; classification band ignored
    days = spark.createDataFrame([(1, d(2024, 6, 14)), (1, d(2024, 6, 30)), (1, d(2024, 7, 1))], "tile_no int, burn_date date")
    got = {r["burn_date"]: (r["tier"], r["lookback"]) for r in satellite.choose_day(days, accepted).collect()}
    # the lower tier wins over the more recent day, until it leaves the 30-day window
    assert got == {d(2024, 6, 14): (0, 13), d(2024, 6, 30): (0, 29), d(2024, 7, 1): (2, 21)}


def test_satellite_age(spark):
    rows = [("[{\"acquisition_date\":\"2024-06-01\"},{\"acquisition_date\":\"2024-06-09\"},{\"acquisition_date\":\"2024-06-20\"}]",), ("not json",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    age = provenance.sat_age_days(F.lit("2024-06-10").cast("date"), provenance.parse_stats(F.col("s")))
    assert [r[0] for r in df.select(age).collect()] == [1, 0, 0]


def test_rolling_needs_full_windows_and_counts_rows(spark):
    start = dt.datetime(2024, 1, 1)
    hours = [h for h in range(30) if h != 5]
    rows = [(start + dt.timedelta(hours=h), 57.0, -122.0, float(h) if h != 8 else None, 0.01 * (((h - 1) % 24) + 1)) for h in hours]
    df = spark.createDataFrame(rows, "valid_time timestamp, latitude double, longitude double, t2m double, tp double")
    out = weather.hourly_features(df).orderBy("valid_time").collect()
    assert out[0]["tp_hourly"] is None and abs(out[1]["tp_hourly"] - 0.01) < 1e-12  # hour 1 restarts
    assert all(r["t2m_24h_max"] is None for r in out)  # 29 rows, one of them unknown in every full window
    assert out[23]["tp_24h_sum"] is None and out[24]["tp_24h_sum"] is not None


def test_duplicate_hours_keep_the_fuller_source(spark):
    t = dt.datetime(2024, 5, 31, 12)
    rows = [(t, 0, 57.0, 1.0), (t, 0, 58.0, None), (t, 1, 57.0, None), (t, 1, 58.0, None)]
    df = spark.createDataFrame(rows, "valid_time timestamp, source int, latitude double, t2m double")
    assert {r["source"] for r in weather.deduplicate_hours(df).collect()} == {0}


def test_needed_months_reach_over_the_year(spark):
    rows = [(dt.datetime(2024, 1, 1, 19),), (dt.datetime(2024, 6, 30, 19),), (None,)]
    got = weather.needed_months(spark.createDataFrame(rows, "noon_utc timestamp_ntz")).collect()
    assert {(r["year"], r["month"]) for r in got} == {(2023, 12), (2024, 1), (2024, 6), (2024, 7)}


def test_quality_marks_missing_features(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("x", 0, 0, 1.0, 1.0), ("x", 0, 1, nan, 1.0), ("y", 0, 0, 1.0, None), ("y", 0, 1, 2.0, None), ("z", 0, 0, 1.0, 2.0), ("w", 0, 0, inf, 0.0)]
    df = spark.createDataFrame(rows, "day string, pixel_y int, pixel_x int, a double, b double")
    bad = {(r["day"], r["pixel_x"]) for r in quality.quality_mask(df, ["a", "b"], ("day",)).collect()}
    assert bad == {("x", 1), ("y", 0), ("y", 1), ("w", 0)}
    s = quality.quality_summary(quality.tile_day_quality(df, ["a", "b"], ("day",))).first()
    assert (s["clean_days"], s["problem_days"]) == (1, 3)


def test_statistics_and_normalisation(spark):
    df = spark.createDataFrame([(1.0, -9999.0), (2.0, 4.0), (None, 6.0), (float("nan"), 8.0)], "a double, dem double")
    table = stats.feature_stats(df, ["a"]).unionByName(stats.feature_stats(df, ["dem"], k.TERRAIN_NODATA)).collect()
    a, dem = {r["feature"]: r for r in table}["a"], {r["feature"]: r for r in table}["dem"]
    assert (a["count"], a["mean"], a["min"], a["max"]) == (2, 1.5, 1.0, 2.0) and abs(a["std"] - 0.5 - 1e-8) < 1e-15
    assert (dem["count"], dem["mean"]) == (3, 6.0)


def channel_tables(spark):
    cells = spark.createDataFrame([(1, 0, y, x) for y in range(2) for x in range(2)], "day int, tile int, pixel_y int, pixel_x int")
    env = cells.select("*", *[(F.col("pixel_x") + i).cast("double").alias(c) for i, c in enumerate(k.DYNAMIC_FEATURES)])
    env = env.withColumn("rh", F.when(F.col("pixel_x") == 0, F.col("rh")))
    statics = cells.select("tile", "pixel_y", "pixel_x", *[F.lit(90.0).alias(c) for c in k.STATIC_FEATURES])
    masks = cells.where("pixel_y = 1").select("day", "tile", "pixel_y", "pixel_x", F.lit(0.03).alias("fireday_grid"))
    return env, statics, masks


def test_channels_order_and_packing(spark):
    env, statics, masks = channel_tables(spark)
    px = channels.assemble_channels(env, statics, masks, None, ("day", "tile"), ("tile",))
    assert px.columns == ["day", "tile", "pixel_y", "pixel_x", *k.CHANNELS]
    row = px.where("pixel_y = 1 AND pixel_x = 1").first()
    assert row["rh"] == 0.0 and abs(row["s2_scl"] - 15e-4) < 1e-12 and row["aspect_sin"] == 1.0
    assert (row["previous_burn_mask"], row["fireday_grid"]) == (1.0, 0.03)
    x = channels.pack(px, ("day", "tile")).first()["x"]
    assert len(x) == 25 * 4 and np.allclose(x[-8:-4], [0, 0, 1, 1]) and np.allclose(x[:4], [0, 1, 0, 1])


def test_archives_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, (25, 4, 4)).astype(np.float16)
    seq = rng.integers(0, 50, (3, 25, 4, 4)).astype(np.float16)
    y = (rng.random((4, 4)) < 0.5).astype(np.uint8)
    np.savez(tmp_path / "sample_0.npz", x=x, y=y, delta_t=np.uint8(3))
    np.savez(tmp_path / "sample_1.npz", x=seq, y=y, positions=np.arange(3, dtype=np.uint8))
    rows = samples.ingest_archives(spark, str(tmp_path)).persist()
    assert rows.count() == 16 + 3 * 16
    one = rows.where("sample LIKE '%sample_1.npz' AND step = 2 AND pixel_y = 3 AND pixel_x = 1").first()
    assert [one[c] for c in k.CHANNELS] == seq[2, :, 3, 1].astype(float).tolist() and one["label"] == y[3, 1]


def test_archive_with_wrong_shape_fails(spark):
    buffer = io.BytesIO()
    np.savez(buffer, x=np.zeros((2, 4, 4), np.float16), y=np.zeros((4, 4), np.uint8))
    df = spark.createDataFrame([("p", bytearray(buffer.getvalue()))], "path string, content binary")
    with pytest.raises(Exception, match="unexpected shapes"):
        samples.decode_archives(df).collect()


def test_scl_scale_and_masks(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (5.0,)], "v double")
    got = [r[0] for r in df.select(values.valid_or_null(F.col("v"), 0.0)).collect()]
    assert got == [None, None, 5.0]
    row = df.where("v = 5").select(values.scale_satellite(F.col("v"), "s2_scl").alias("a"), values.scale_satellite(F.col("v"), "SCL", 0.1).alias("b")).first()
    assert abs(row["a"] - 5e-4) < 1e-15 and abs(row["b"] - 0.5) < 1e-15


def test_decision_boundary_differs_by_flag(spark):
    df = spark.createDataFrame([(0.5, 1)], "score double, label int")
    assert metrics.binary_metrics(df, inclusive=True).first()["tp"] == 1
    assert metrics.binary_metrics(df, inclusive=False).first()["tp"] == 0


def test_mosaic_never_broadcasts_exploded_pixels(spark):
    """An explode counts as large as its input for the planner, so the pixels of many scenes looked small enough to broadcast."""
    scenes = spark.range(20).selectExpr("id AS scene_id", "0 AS tile_no", "date'2024-06-01' AS acq_date", "1.0 AS cloud_cover")
    pixels = spark.range(20).selectExpr("id AS scene_id", "0 AS band", "explode(sequence(0, 999)) AS pixel", "1 AS value")
    mosaic = satellite.daily_mosaic(scenes, pixels)
    plan = mosaic._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert mosaic.count() == 1000


def test_larger_holes_shuffle_once(spark, monkeypatch):
    """Several tile-days in chunks of few cells, with a hole of four cells that stays open, in one shuffle."""
    monkeypatch.setattr(stencil, "CELLS_AT_ONCE", 60)
    rng = np.random.default_rng(4)
    masks = [rng.random((GRID, GRID)) < p for p in (0.3, 0.6, 0.9, 1.0)]
    masks[3][2, 2:6] = False
    rows = [(t, "d", int(y), int(x)) for t, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    frame = spark.createDataFrame(rows, "tile int, day string, pixel_y int, pixel_x int")
    for size in (2, 3, 5):
        filled = stencil.fill_holes(frame, ("tile", "day"), size, GRID)
        got = {tuple(r) for r in filled.collect()}
        want = {(t, "d", int(y), int(x)) for t, m in enumerate(masks) for y, x in zip(*np.nonzero(small_background(m, size)))}
        assert got == want
        assert filled._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1
