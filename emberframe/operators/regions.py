"""Points and boxes against polygons with holes, through an index of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.operators.satellite import search_catalogue

NEAR = 1e-9  # part of a cell by which rounding may move the place of an edge


def ring_edges(vertices: DataFrame, *keys: str) -> DataFrame:
    """Edges x1, y1, x2, y2 of closed rings from their vertices (keys, seq, lon, lat)."""
    along = Window.partitionBy(*keys).orderBy("seq")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(along), F.first(c).over(whole))
    return vertices.select(*keys, F.col("lon").alias("x1"), F.col("lat").alias("y1"), after("lon").alias("x2"), after("lat").alias("y2"))


def _x_at(e, y: Column) -> Column:
    return e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])


def _range(low: Column, high: Column, cell: float) -> Column:
    """Cells that an edge touches; an edge on a border, or beside it by rounding, belongs to the cells on both sides."""
    return F.sequence(F.ceil(low / F.lit(cell) - F.lit(NEAR)) - 1, F.floor(high / F.lit(cell) + F.lit(NEAR)))


def _crosses(e, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the east meets the edge."""
    return (e["y1"] != e["y2"]) & ((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y1"] != e["y2"], _x_at(e, y) > x)


def _beyond(e, x: Column, y: Column) -> Column:
    """The same for a border x: an edge with both ends on one side of it lies on that side, however its place is rounded."""
    right = (e["x1"] > x) & (e["x2"] > x)
    return ((e["y1"] > y) != (e["y2"] > y)) & (right | (((e["x1"] > x) != (e["x2"] > x)) & _crosses(e, x, y)))


def _over(e, x: Column, y: Column) -> Column:
    """Whether the edge meets the border x above y. It is read off ``_beyond``, so that both agree at every rounding."""
    rises = (e["x1"] > x) == (e["y1"] > y)  # the end beyond the border is the upper one
    met = F.when((e["y1"] > y) == (e["y2"] > y), e["y1"] > y).otherwise(_beyond(e, x, y) != rises)
    return ((e["x1"] > x) != (e["x2"] > x)) & met


def index_regions(vertices: DataFrame, cell: float) -> DataFrame:
    """Rows (_cx, _cy, _regions) for every grid cell that a region (name, ring, seq, lon, lat) touches or fills.

    For each region of a cell: whether the cell's upper right corner lies inside (the parity of the edges that a ray to the
    east meets, one aggregate over the edges of that row) and the edges near the cell. Holes are rings like others: parity
    counts them. Only regions are multiplied here: by the cells of their bounding box, and edges by the cells of theirs.
    """
    edges = ring_edges(vertices, "name", "ring").drop("ring")
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    box = edges.groupBy("name").agg(
        F.min(low("x1", "x2")).alias("x0"), F.max(high("x1", "x2")).alias("x3"), F.min(low("y1", "y2")).alias("y0"), F.max(high("y1", "y2")).alias("y3")
    )
    cells = box.withColumn("_cx", F.explode(_range(F.col("x0"), F.col("x3"), cell))).withColumn(
        "_cy", F.explode(_range(F.col("y0"), F.col("y3"), cell))
    ).select("name", "_cx", "_cy")
    corner_x, corner_y = (F.col("_cx") + 1) * F.lit(cell), (F.col("_cy") + 1) * F.lit(cell)
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    banded = edges.withColumn("_cy", F.explode(_range(low("y1", "y2"), high("y1", "y2"), cell)))
    # A band holds an edge for each row of cells it touches; the corner above a row is tested against that row's edges only.
    parity = cells.join(banded, ["name", "_cy"]).where(_beyond(e, corner_x, corner_y)).groupBy("name", "_cx", "_cy").agg((F.count("*") % 2).alias("_odd"))
    near = banded.withColumn("_cx", F.explode(_range(low("x1", "x2"), high("x1", "x2"), cell))).groupBy("name", "_cx", "_cy").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges")
    )
    joined = cells.join(parity, ["name", "_cx", "_cy"], "left").join(near, ["name", "_cx", "_cy"], "left")
    held = joined.where(F.col("_edges").isNotNull() | (F.col("_odd") == 1)).select(
        "_cx", "_cy", F.struct("name", (F.coalesce("_odd", F.lit(0)) == 1).alias("odd"), F.coalesce("_edges", F.array()).alias("edges")).alias("r")
    )
    return held.groupBy("_cx", "_cy").agg(F.collect_list("r").alias("_regions"))


def locate_in_regions(points: DataFrame, index: DataFrame, cell: float, into: str = "region", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with the name of their region, NULL outside all; where regions overlap the first name counts.

    One equi-join on the cell, which never multiplies a point. Inside a cell the path from the point east to the border and
    then up to the corner is followed: each edge of the cell that it crosses turns the corner's answer around. An edge adds its
    crossings of the whole ray from the point, from the border and from the corner, so the answer is that of the ray from
    the point against all edges, for points on an edge too.
    """
    x, y = F.col(lon), F.col(lat)
    corner_x, corner_y = (F.col("_cx") + 1) * F.lit(cell), (F.col("_cy") + 1) * F.lit(cell)

    def crossings(edges: Column) -> Column:
        east = lambda e: _crosses(e, x, y) != _beyond(e, corner_x, y)
        up = lambda e: _over(e, corner_x, y) != _over(e, corner_x, corner_y)
        turns = F.transform(edges, lambda e: (east(e) != up(e)).cast("int"))
        return F.aggregate(turns, F.lit(0), lambda a, t: a + t)

    inside = lambda r: (crossings(r["edges"]) % 2 == 1) != r["odd"]
    placed = points.withColumns({"_cx": F.floor(x / F.lit(cell)), "_cy": F.floor(y / F.lit(cell))}).join(index, ["_cx", "_cy"], "left")
    names = F.transform(F.filter("_regions", inside), lambda r: r["name"])
    return placed.withColumn(into, F.array_min(names)).drop("_cx", "_cy", "_regions")


def _meets_box(ring: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether a polygon (its ring as an array of lon, lat) and a box have a point in common."""
    closed = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, closed, lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")))

    def hits(e: Column) -> Column:
        side = lambda x, y: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        sides = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        apart = (F.greatest(e["ax"], e["bx"]) < x0) | (F.least(e["ax"], e["bx"]) > x1) | (F.greatest(e["ay"], e["by"]) < y0) | (F.least(e["ay"], e["by"]) > y1)
        return ~apart & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    over = lambda e: F.when(
        (e["ay"] > y0) != (e["by"] > y0), (e["ax"] + (y0 - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"]) > x0).cast("int")
    ).otherwise(0)
    around = F.aggregate(F.transform(edges, over), F.lit(0), lambda a, t: a + t) % 2 == 1
    return F.exists(edges, hits) | around


def search_footprints(tiles: DataFrame, vertices: DataFrame, buffer_deg: float = 0.1, cell_deg: float = 0.5) -> DataFrame:
    """Scenes whose footprint polygon (scene_id, acq_date, seq, lon, lat) meets a tile's box (plus buffer) in the tile's date window.

    Bounding boxes find the candidates by an equi-join on coarse cells; the polygon then decides. A footprint has few vertices.
    """
    shapes = vertices.groupBy("scene_id", "acq_date").agg(
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))).alias("_ring"),
    )
    found = search_catalogue(tiles, shapes, buffer_deg, cell_deg)
    with_ring = found.join(shapes.select("scene_id", "_ring"), "scene_id")
    widened = (F.col("min_lon") - buffer_deg, F.col("max_lon") + buffer_deg, F.col("min_lat") - buffer_deg, F.col("max_lat") + buffer_deg)
    return with_ring.where(_meets_box(F.col("_ring"), *widened)).select(*found.columns)
