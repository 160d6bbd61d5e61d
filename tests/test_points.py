"""Small hand-computed cases for the order, boundary and calendar rules of tiles and masks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberframe.catalog import fixtures
from emberframe.functions import geo, timeops, values
from emberframe.operators import burn, pairing, surface, tiles
from emberframe.sources import burn_points, tile_index


def fires_frame(spark, rows):
    return spark.createDataFrame(rows, "year int, tile_col int, tile_row int, dob int, id string, fireday int, first_seq bigint")


def test_projection_origin_and_missing_columns(spark):
    df = spark.createDataFrame([(-91.86666666666666, 63.390675)], "lon double, lat double")
    row = geo.with_projection(df).first()
    assert abs(row["easting"] - 6_200_000) < 1e-6 and abs(row["northing"] - 3_000_000) < 1e-6
    with pytest.raises(ValueError):
        geo.with_projection(df.drop("lat"))


def test_pixels_count_from_the_top_and_are_clipped(spark):
    df = spark.createDataFrame([(23040.0 * 3, 23040.0 * 5), (23040.0 * 4 - 1e-9, 23040.0 * 6 - 1.0)], "easting double, northing double")
    a, b = geo.with_tile(df).orderBy("northing").collect()
    assert (a["tile_col"], a["tile_row"], a["pixel_x"], a["pixel_y"]) == (3, 5, 0, 255)
    assert (b["tile_col"], b["tile_row"], b["pixel_x"], b["pixel_y"]) == (3, 5, 255, 0)


def test_negative_tiles_parse(spark):
    df = spark.createDataFrame([("tile_-3_12_DOB_2024_188",)], "k string")
    row = df.select(*[c.alias(n) for n, c in geo.parse_tile_key(F.col("k")).items()]).first()
    assert row.asDict() == {"tile_id": "tile_-3_12", "tile_col": -3, "tile_row": 12, "year": 2024, "dob": 188}


def test_last_row_wins_even_when_it_is_zero(spark):
    rows = [(1, 5.0, 10), (1, 0.0, 11), (2, 0.0, 20), (2, 7.0, 21)]
    df = spark.createDataFrame(rows, "pixel int, area double, row_seq bigint")
    got = {r["pixel"]: r["burned"] for r in tiles.rasterise_last(df, {"burned": F.col("area") > 0}, ("pixel",)).collect()}
    assert got == {1: False, 2: True}


def test_day_end_is_24_hours_after_start_on_a_clock_change(spark):
    day = spark.createDataFrame([(dt.date(2024, 3, 10), "America/Edmonton")], "d date, tz string")
    row = day.select(*[e.alias(n) for n, e in timeops.local_day_to_utc(F.col("d"), F.col("tz")).items()]).first()
    assert row["start_utc"] == dt.datetime(2024, 3, 10, 7) and row["end_utc"] == dt.datetime(2024, 3, 11, 7)
    assert row["noon_utc"] == dt.datetime(2024, 3, 10, 18)


def test_time_zone_defaults_to_utc(spark):
    regions = spark.createDataFrame([("A", -130.5, -120.2)], "name string, lon_min double, lon_max double")
    pts = spark.createDataFrame([(-130.5,), (-120.2,), (-120.21,), (5.0,)], "lon double")
    got = {r["lon"]: r["tz"] for r in tiles.with_time_zone(pts, regions).collect()}
    assert got == {-130.5: "A", -120.2: "UTC", -120.21: "A", 5.0: "UTC"}


def test_next_day_never_crosses_the_year(spark):
    days = spark.createDataFrame([(2023, 1, 1, 365), (2024, 1, 1, 1), (2024, 1, 1, 2)], "year int, tile_col int, tile_row int, dob int")
    assert [(r["year"], r["dob"]) for r in pairing.next_day_pairs(days).collect()] == [(2024, 1)]


def test_sequences_need_clean_inputs_but_not_a_clean_target(spark):
    days = spark.createDataFrame([(2024, 1, 1, d) for d in range(10, 15)], "year int, tile_col int, tile_row int, dob int")
    clean = days.where("dob <> 13")
    got = [r["start_dob"] for r in pairing.sequences(clean, 3, days).collect()]
    assert got == [10]
    assert pairing.sequence_steps(pairing.sequences(clean, 3, days), 3).count() == 3


HISTORY = [
    # id, fireday, pixel_x: fire B is listed first on day 3
    ("A", 1, 0), ("A", 3, 1), ("B", 2, 0), ("B", 3, 2), ("B", 4, 3),
]


def history_tables(spark):
    masks = spark.createDataFrame(
        [(2024, 1, 1, i, d, 0, x) for i, d, x in HISTORY],
        "year int, tile_col int, tile_row int, id string, fireday int, pixel_y int, pixel_x int",
    )
    fires = fires_frame(spark, [
        (2024, 1, 1, 101, "A", 1, 5), (2024, 1, 1, 102, "B", 2, 6), (2024, 1, 1, 103, "B", 3, 7),
        (2024, 1, 1, 103, "A", 3, 8), (2024, 1, 1, 104, "B", 4, 9),
    ])
    return fires, masks


def test_history_first_writer_is_the_first_listed_fire(spark):
    fires, masks = history_tables(spark)
    rows = burn.current_mask(fires, masks).where("dob = 103").collect()
    assert {r["pixel_x"]: r["first_fireday"] for r in rows} == {0: 2, 1: 3, 2: 3}
    day_only = burn.current_mask(fires, masks, history=False).where("dob = 103").collect()
    assert {r["pixel_x"]: r["first_fireday"] for r in day_only} == {1: 3, 2: 3}
    # only the fires listed that day count: fire A is not listed on day 104
    assert {r["pixel_x"] for r in burn.current_mask(fires, masks).where("dob = 104").collect()} == {0, 2, 3}


def test_growth_labels_agree_in_both_forms(spark):
    fires, masks = history_tables(spark)
    pairs = pairing.next_day_pairs(pairing.tile_days(fires))
    for history in (True, False):
        current, target = burn.current_mask(fires, masks, history), burn.day_mask(fires, masks)
        slow = {(r["dob"], r["pixel_x"]) for r in burn.growth_labels(pairs, current, target).collect()}
        fast = {(r["dob"], r["pixel_x"]) for r in burn.new_growth(fires, masks, pairs, history).collect()}
        assert slow == fast
    three = burn.growth_labels(pairs, burn.current_mask(fires, masks), burn.day_mask(fires, masks), classes=3)
    got = {(r["dob"], r["pixel_x"]): r["label"] for r in three.where("dob = 102").collect()}
    assert got == {(102, 0): 1, (102, 1): 2, (102, 2): 2}


def test_fireday_channel_and_vintage(spark):
    df = spark.createDataFrame([(0, 2020), (7, 2021), (-1, 2019)], "fireday int, year int")
    rows = df.select(values.fireday_channel(F.col("fireday")).alias("c"), timeops.fuel_vintage(F.col("year")).alias("v")).collect()
    assert [(r["c"], r["v"]) for r in rows] == [(0.0, "2015"), (0.07, "2020"), (0.0, "2015")]


def test_feature_set_errors_before_any_job():
    with pytest.raises(ValueError):
        values.feature_set("unknown")
    with pytest.raises(ValueError):
        values.feature_set("all_channels", ["tmax"])
    assert len(values.feature_set("environment_only")) == 23 and len(values.feature_set("no_satellite")) == 18


def test_asof_takes_the_newest_finished_composite_above_the_floor(spark):
    d = dt.date
    days = spark.createDataFrame(
        [("f", 2024, 60, d(2024, 2, 29)), ("f", 2024, 70, d(2024, 3, 10)), ("g", 2024, 120, d(2024, 4, 29))],
        "id string, year int, dob int, burn_date date",
    )
    schedule = spark.createDataFrame([(d(2024, 2, 10),), (d(2024, 2, 23),), (d(2024, 1, 1),)], "time_start date")
    got = {(r["id"], r["dob"]): r["time_start"] for r in surface.asof_composite(days, schedule).collect()}
    # 10 Feb + 16 d = 26 Feb; 23 Feb + 16 d = 10 Mar; fire g starts too late for any (floor 29 Mar)
    assert got == {("f", 60): d(2024, 2, 10), ("f", 70): d(2024, 2, 23), ("g", 120): None}


def test_csv_row_order_and_absent_years(spark, tmp_path):
    header = ",".join(burn_points.SCHEMA.names)
    line = lambda fire, lon, area: f"{fire},{lon},56.0,1,2021,188,{area},{area}" + ",0" * 11
    rows = [line("2021_1", -120.0 + i * 1e-4, i) for i in range(500)]
    (tmp_path / "pts_2021.csv").write_text("\n".join([header, *rows]) + "\n")
    df = burn_points.read_burn_points(spark, str(tmp_path / "pts_{year}.csv"), [2020, 2021, 2022], ("ID", "lon", "year", "DOB", "cumuarea"))
    assert df.columns == ["id", "lon", "year", "dob", "cumuarea", "row_seq"]
    assert [r["cumuarea"] for r in df.orderBy("row_seq").collect()] == [float(i) for i in range(500)]
    with pytest.raises(FileNotFoundError):
        burn_points.read_burn_points(spark, str(tmp_path / "pts_{year}.csv"), [1999])


def test_whole_file_index_and_override(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "tile_1_2_DOB_2023_5": [\n    {"fire_id": "x", "day_key": "day_002"}\n  ],\n "tile_1_2_DOB_2023_6": [{"fire_id": "x", "day_key": "day_003"}]}')
    (tmp_path / "b.json").write_text('{"tile_1_2_DOB_2023_5": [{"fire_id": "z", "day_key": "day_009"}, {"fire_id": "y", "day_key": "day_001"}]}')
    rows = tile_index.read_tile_fires_json(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], whole_file=True)
    got = sorted((r["dob"], r["first_seq"], r["id"], r["fireday"]) for r in tile_index.later_source_wins(rows).collect())
    assert got == [(5, 0, "z", 9), (5, 1, "y", 1), (6, 0, "x", 3)]


def test_spread_follows_the_rows(spark, monkeypatch):
    """A larger table is dealt to more tasks, not to larger ones."""
    monkeypatch.setattr(fixtures, "ROWS_PER_PARTITION", 100)
    spread = fixtures._spread(spark.range(2345).toDF("k"))
    sizes = [r["n"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2345 and max(sizes) <= 110


def test_growth_by_words_of_days(spark):
    """Three classes and days on both sides of the borders of a word, against the labels of whole masks."""
    days = [1, 2, 62, 63, 64, 65, 126, 127, 128, 129, 255, 256, 365, 366]
    fires = spark.createDataFrame(
        [(2020, 0, 0, d, f, d - 40 + i, 10 * d + i) for d in days for i, f in enumerate("AB") if (d + i) % 5],
        "year int, tile_col int, tile_row int, dob int, id string, fireday int, first_seq bigint",
    )
    masks = spark.createDataFrame(
        [(2020, 0, 0, f, d - 40 + i, 0, (d * 7 + 3 * i + j) % 23) for d in days for i, f in enumerate("AB") for j in range(3)],
        "year int, tile_col int, tile_row int, id string, fireday int, pixel_y int, pixel_x int",
    ).distinct()
    pairs = pairing.next_day_pairs(pairing.tile_days(fires))
    found = lambda df: sorted((r["dob"], r["pixel_x"], r["label"]) for r in df.collect())
    for history in (True, False):
        current, target = burn.current_mask(fires, masks, history), burn.day_mask(fires, masks)
        want = found(burn.growth_labels(pairs, current, target, classes=3))
        assert want and found(burn.new_growth(fires, masks, pairs, history, classes=3)) == want


def test_history_multiplies_days_after_the_only_shuffle(spark):
    """Pixels of a fire meet its days in one place; the multiplied rows are grouped where they are."""
    import random

    rng = random.Random(3)
    masks = {(2020, rng.randrange(2), 0, f"f{rng.randrange(4)}", 1 + rng.randrange(30), rng.randrange(3), rng.randrange(256)) for _ in range(400)}
    listed = {(m[0], m[1], m[2], 100 + m[4], m[3], m[4]) for m in masks}
    fires = [(*f, seq) for seq, f in enumerate(rng.sample(sorted(listed), len(listed)))]
    mask_frame = spark.createDataFrame(sorted(masks), "year int, tile_col int, tile_row int, id string, fireday int, pixel_y int, pixel_x int")
    fire_frame = spark.createDataFrame(fires, "year int, tile_col int, tile_row int, dob int, id string, fireday int, first_seq long")
    cells = burn.current_mask(fire_frame, mask_frame)
    first, want = {}, {}
    for y, c, r, i, day, py, px in masks:
        first[y, c, r, i, py, px] = min(day, first.get((y, c, r, i, py, px), 99))
    for y, c, r, dob, i, day, seq in fires:
        for (*at, py, px), f in first.items():
            if at == [y, c, r, i] and f <= day:
                want[y, c, r, dob, py, px] = min((seq, f), want.get((y, c, r, dob, py, px), (9999, 0)))
    got = {tuple(r[c] for c in (*tiles.TILE_DAY, *tiles.PIXEL)): r["first_fireday"] for r in cells.collect()}
    assert got == {k: f for k, (_, f) in want.items()}
    plan = cells._jdf.queryExecution().sparkPlan().toString()
    executed = cells._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Generate") == 2 and executed.count("Exchange") == 1
    assert executed.index("Generate") < executed.index("Exchange")  # the shuffle lies below: rows are multiplied after it


def test_last_frames_against_brute_force(spark):
    """Every start of three days that a burned day of the pixel serves, without a shuffle of the multiplied rows."""
    days = {(0, 5): 1, (0, 6): 2, (0, 9): 3, (1, 5): 4, (1, 8): 5, (1, 30): None}
    rows = [(2020, 0, 0, d, 0, x, v) for (x, d), v in days.items()]
    frame = spark.createDataFrame(rows, "year int, tile_col int, tile_row int, dob int, pixel_y int, pixel_x int, v int")
    last = burn.last_frames(frame, 3, "v")
    want = {}
    for (x, d), v in sorted(days.items()):
        for start in range(d - 2, d + 1):
            want[start, x] = v
    assert {(r["start_dob"], r["pixel_x"]): r["v"] for r in last.collect()} == want and last.count() == len(want)
    plan = last._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.index("Generate") < plan.index("Window") < plan.index("Exchange") and plan.count("Exchange") == 1
