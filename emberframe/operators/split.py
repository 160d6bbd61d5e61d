"""Leak-free stratified split of super-fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe import constants as k
from emberframe.functions.geo import fire_size
from emberframe.functions.probability import order_hash
from emberframe.operators import ranking, tiles
from emberframe.session import cut_lineage


def super_fire_stats(points: DataFrame, members: DataFrame) -> DataFrame:
    """Extent, centroid and size of every super-fire.

    Points are folded per fire first, so a super-fire with most of the points costs no more than
    its number of fires; sums (not averages) are merged.
    """
    per_fire = points.groupBy("id").agg(
        F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
        F.sum("lat").alias("sum_lat"), F.sum("lon").alias("sum_lon"), F.count("*").alias("n"),
    )
    merged = per_fire.join(members, "id").groupBy("super_id").agg(
        F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"),
        F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"),
        (F.sum("sum_lat") / F.sum("n")).alias("center_lat"), (F.sum("sum_lon") / F.sum("n")).alias("center_lon"),
    )
    return merged.withColumn(
        "fire_size", fire_size(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    )


def size_and_place_bins(stats: DataFrame) -> DataFrame:
    """Size, latitude and longitude bins from exact quantiles.

    The statistics (one row per super-fire) are read many times from here on, so they are written
    once to the shared folder.
    """
    base = cut_lineage(stats)
    wanted = (
        ("fire_size", k.SIZE_QUANTILES, k.SIZE_LABELS, "size_bin"),
        ("center_lat", (0.5,), k.LAT_LABELS, "lat_bin"),
        ("center_lon", (0.5,), k.LON_LABELS, "lon_bin"),
    )
    out = base.withColumns({f"_e_{name}": ranking.exact_quantiles(base, v, p).scalar() for v, p, _, name in wanted})
    out = out.withColumns({n: ranking.bin_by_quantiles(v, F.col(f"_e_{n}"), p, labels) for v, p, labels, n in wanted})
    return out.drop(*[f"_e_{w[3]}" for w in wanted])


def _fall_back(df: DataFrame, label: str, other: Column, smallest: int) -> DataFrame:
    """Replace labels held by fewer than ``smallest`` rows (counts are one row per label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    return (
        df.join(F.broadcast(counts), label)  # one row per stratum: at most 17
        .withColumn(label, F.when(F.col("_n") < smallest, other).otherwise(F.col(label)))
        .drop("_n")
    )


def strata(binned: DataFrame, smallest: int = k.MIN_STRATUM) -> DataFrame:
    """Size/latitude/longitude stratum; rare ones fall back to the size bin, then to 'Large'."""
    labelled = cut_lineage(binned.withColumn("stratum", F.concat_ws("_", "size_bin", "lat_bin", "lon_bin")))
    labelled = _fall_back(labelled, "stratum", F.col("size_bin"), smallest)
    return _fall_back(labelled, "stratum", F.lit(k.FALLBACK_STRATUM), smallest)


def _largest_remainder(counts: DataFrame, size: str, total: Column, out: str) -> DataFrame:
    """Deal ``total`` places to strata in proportion to ``size``; the largest remainders get what the quotients leave."""
    every = Window.partitionBy()  # one row per stratum: at most 17
    share = F.col(size) * total
    whole = F.greatest(F.sum(size).over(every), F.lit(1))
    dealt = counts.withColumns({"_total": total, "_q": F.floor(share / whole), "_r": share % whole})
    order = F.row_number().over(Window.orderBy(F.desc("_r"), "stratum"))
    dealt = dealt.withColumn(out, F.col("_q") + (order <= F.col("_total") - F.sum("_q").over(every)).cast("bigint"))
    return dealt.drop("_total", "_q", "_r")


def stratified_split(stratified: DataFrame, train: float = 0.7, seed: int = 42, key: str = "super_id") -> DataFrame:
    """Add ``split``: hash order decides within each stratum; the rest is halved into val and test.

    The totals are fixed (the held-out part and the test half are rounded up) and dealt to the strata by largest remainder.

    If a stratum leaves fewer than two members for val and test, those two are split without strata.
    """
    stratified = cut_lineage(stratified)
    ranked = ranking.rank_by_hash(stratified, ["stratum"], order_hash(seed, F.col(key)), [key], "_rank")
    counts = stratified.groupBy("stratum").agg(F.count("*").alias("_n"))
    every = Window.partitionBy()
    # one row per stratum: at most 17
    held_out = F.ceil(F.round(F.sum("_n").over(every) * F.lit(1 - train), 6))
    plan = _largest_remainder(counts, "_n", F.sum("_n").over(every) - held_out, "_train")
    plan = (
        plan.withColumn("_rest", F.col("_n") - F.col("_train"))
        .withColumn("_rare", F.max(F.col("_rest").between(1, 1)).over(every))
        .withColumn("_all_rest", F.sum("_rest").over(every))
    )
    plan = _largest_remainder(plan, "_rest", F.floor(F.col("_all_rest") / 2), "_val")
    placed = ranked.join(F.broadcast(plan), "stratum")
    in_train = F.col("_rank") <= F.col("_train")
    rest = ranking.rank_by_hash(
        placed.where(~in_train).withColumn("_any", F.lit(1)), ["_any"], order_hash(seed, F.col(key)), [key], "_rest_rank"
    ).drop("_any")
    by_stratum = F.col("_rank") - F.col("_train") <= F.col("_val")
    overall = F.col("_rest_rank") <= F.floor(F.col("_all_rest") / 2)
    is_val = F.when(F.col("_rare"), overall).otherwise(by_stratum)
    out = [c for c in stratified.columns]
    return (
        placed.where(in_train).select(*out, F.lit("train").alias("split"))
        .unionByName(rest.select(*out, F.when(is_val, "val").otherwise("test").alias("split")))
    )


def split_fires(members: DataFrame, split: DataFrame) -> DataFrame:
    """Split of every individual fire through its super-fire."""
    return members.join(split.select("super_id", "split"), "super_id").select("id", "super_id", "split")


def crossing_pairs(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Samples whose input or target day has a fire of another split than the sample's: empty for a valid build."""
    days = placed.select("year", *tiles.TILE, F.col("dob").alias("day"), F.col("split").alias("other")).distinct()
    used = pairs.select("year", *tiles.TILE, "dob", "split", F.explode(F.array("dob", "next_dob")).alias("day"))
    return used.join(days, ["year", *tiles.TILE, "day"]).where("split <> other").select("year", *tiles.TILE, "dob", "split").distinct()


def leaks(fires: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tile-days that occur in more than one split: empty for a valid split."""
    placed = fires.join(assigned.select("id", "split"), "id")
    per_split = lambda s: placed.where(F.col("split") == s).select(*tiles.TILE_DAY)
    train, val, test = per_split("train"), per_split("val"), per_split("test")
    return train.intersect(val).unionByName(train.intersect(test)).unionByName(val.intersect(test)).distinct()
