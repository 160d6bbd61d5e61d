"""Nearest site to each point when the sites lie anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

SITES_PER_CELL = 4.0
SITES_PER_LIST = 1024


def nearest_site(points: DataFrame, sites: DataFrame, key: str, site: str, x: str = "lon", y: str = "lat", cell: float | None = None) -> DataFrame:
    """``points`` with ``site`` (the id of the nearest site) and ``distance``; ties go to the smaller id, no data is NULL.

    ``key`` is unique in ``points``; both tables have the coordinates ``x`` and ``y``. Points outside the extent of the sites, or
    without coordinates, get NULL.

    The occupied cells of a grid are kept with the exact boxes of their sites and of their points. A cell of points first looks at the
    3 x 3 cells around it; boxes say at least how far and at most how far the nearest site of any of its points is. Once the smallest such
    maximum lies within the searched square, no site beyond it can be nearer, and the sites of the cells whose minimum does not exceed it are the
    cell's list. Cells that are not settled go on with cells twice as large, so one in an empty region takes a number of rounds that grows with the
    logarithm of its distance. Points travel once, to the list of their cell; a list of more than SITES_PER_LIST sites comes in several. By
    default a cell holds about four sites.
    """
    at = lambda c, step: F.floor(F.col(c) / F.lit(step))
    known = sites.where(F.col(site).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    edge = known.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n")).first()
    none = {site: F.lit(None).cast(sites.schema[site].dataType), "distance": F.lit(None).cast("double")}
    if not edge["n"]:
        return points.withColumns(none)
    if cell is None:
        width, height = edge["x1"] - edge["x0"], edge["y1"] - edge["y0"]
        cell = (max(width * height, 1e-12) * SITES_PER_CELL / edge["n"]) ** 0.5 if width and height else max(width, height, 1.0) * SITES_PER_CELL / edge["n"]
    cells = cut_lineage(known.groupBy(at(x, cell).alias("_cx"), at(y, cell).alias("_cy")).agg(
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")
    ), "cells")
    inside = F.col(x).between(edge["x0"], edge["x1"]) & F.col(y).between(edge["y0"], edge["y1"])
    points = cut_lineage(points, "points")
    empty = points.withColumns(none)
    asked = points.where(inside).withColumns({"_gx": at(x, cell), "_gy": at(y, cell)})
    waiting = cut_lineage(asked.groupBy("_gx", "_gy").agg(
        F.min(x).alias("_px0"), F.max(x).alias("_px1"), F.min(y).alias("_py0"), F.max(y).alias("_py1")
    ), "waiting")
    found, level = [], 0
    while True:
        step, size = cell * 2.0**level, 2**level
        ring = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        seen = waiting.withColumn("_o", F.explode(F.array(*ring))).withColumns(
            {"_lx": F.floor(F.col("_gx") / size) + F.col("_o.dx"), "_ly": F.floor(F.col("_gy") / size) + F.col("_o.dy")}
        ).join(cells.withColumns({"_lx": F.floor(F.col("_cx") / size), "_ly": F.floor(F.col("_cy") / size)}), ["_lx", "_ly"])
        gap = lambda c: F.greatest(F.col(f"_{c}0") - F.col(f"_p{c}1"), F.col(f"_p{c}0") - F.col(f"_{c}1"), F.lit(0.0))
        # A site lies on each side of the exact box, so one is as near as the far end of the box is to the far end of the points.
        far = lambda c: F.greatest(F.abs(F.col(f"_{c}1") - F.col(f"_p{c}0")), F.abs(F.col(f"_p{c}1") - F.col(f"_{c}0")))
        rest = lambda c: F.least(
            F.col(f"_p{c}0") - (F.floor(F.col(f"_g{c}") / size) - 1) * F.lit(step), (F.floor(F.col(f"_g{c}") / size) + 2) * F.lit(step) - F.col(f"_p{c}1")
        )
        box = ["_gx", "_gy", "_px0", "_px1", "_py0", "_py1"]
        per_cell = seen.groupBy(*box).agg(
            F.min(F.hypot(far("x"), far("y"))).alias("_most"),
            F.collect_list(F.struct(F.hypot(gap("x"), gap("y")).alias("least"), "_cx", "_cy")).alias("_cells"),
        ).withColumn("_settled", F.col("_most") <= F.least(rest("x"), rest("y")))
        settled = cut_lineage(per_cell.where("_settled").select(
            "_gx", "_gy", F.explode(F.filter("_cells", lambda c: c["least"] <= F.col("_most") * (1 + 1e-12))).alias("c")
        ).select("_gx", "_gy", "c._cx", "c._cy"), "settled")
        found.append(settled)
        waiting = cut_lineage(waiting.join(settled.select("_gx", "_gy").distinct(), ["_gx", "_gy"], "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        level += 1
    pairs = reduce(DataFrame.unionByName, found)
    placed = known.select(F.col(site).alias("_site"), F.col(x).alias("_sx"), F.col(y).alias("_sy"), at(x, cell).alias("_cx"), at(y, cell).alias("_cy"))
    near = pairs.join(placed, ["_cx", "_cy"]).select("_gx", "_gy", F.struct("_site", "_sx", "_sy").alias("_s"))
    place = F.row_number().over(Window.partitionBy("_gx", "_gy").orderBy("_s")) - 1
    lists = near.withColumn("_list", F.floor(place / SITES_PER_LIST)).groupBy("_gx", "_gy", "_list").agg(F.collect_list("_s").alias("_sites"))
    lists = cut_lineage(lists, "lists")
    several = lists.where("_list > 0").select("_gx", "_gy").distinct().withColumn("_several", F.lit(True))
    lists = lists.join(several, ["_gx", "_gy"], "left").withColumn("_several", F.coalesce("_several", F.lit(False)))
    distance = lambda s: F.hypot(F.col(x) - s["_sx"], F.col(y) - s["_sy"])
    least = F.array_min(F.transform("_sites", lambda s: F.struct(distance(s).alias("d"), s["_site"].alias("_site"))))
    met = asked.join(lists, ["_gx", "_gy"])
    result = {site: F.col("_b._site"), "distance": F.col("_b.d")}
    one = met.where("not _several").withColumn("_b", least).withColumns(result).select(empty.columns)
    best = met.where("_several").select(key, least.alias("_b")).groupBy(key).agg(F.min("_b").alias("_b"))
    more = asked.join(several, ["_gx", "_gy"], "left_semi").join(best, key).withColumns(result).select(empty.columns)
    beyond = empty.where(~F.coalesce(inside, F.lit(False)))
    return one.unionByName(more).unionByName(beyond)
