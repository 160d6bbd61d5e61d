"""Super-fires: connected components of fires that share a tile-day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emberframe.operators.skew import SALTS, salted_join
from emberframe.operators.tiles import TILE_DAY
from emberframe.session import cut_lineage


def _attach_minimum(edges: DataFrame, minimum: DataFrame, salts: int) -> DataFrame:
    """Each vertex's minimum onto its edges; the edges of a hub are spread by their other end."""
    return salted_join(edges, minimum, ["u"], F.col("v"), salts=salts)


def _large_star(edges: DataFrame, salts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        _attach_minimum(both.where("v > u"), low, salts)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, salts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _attach_minimum(down, low, salts).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(vertices: DataFrame, edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(id, super_id)``: the smallest id of each component; isolated vertices keep their own.

    Alternating large-star/small-star contraction: edges never multiply, a component with most
    of the graph becomes a star after O(log n) rounds, and every round starts from a table in
    the shared folder.  The write itself reports a fingerprint; an unchanged one ends the loop.
    """
    current = cut_lineage(edges.where("u <> v").select("u", "v"), "edges")
    previous = None
    while True:
        seen = Observation()
        contracted = _small_star(_large_star(current, salts), salts).observe(
            seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        )
        current = cut_lineage(contracted, "edges")
        state = (seen.get["n"], seen.get["h"])
        if state == previous:
            break
        previous = state
    labels = current.select(F.col("u").alias("id"), F.col("v").alias("super_id"))
    return vertices.select("id").distinct().join(labels, "id", "left").withColumn(
        "super_id", F.coalesce("super_id", "id")
    )


def super_fires(fires: DataFrame) -> DataFrame:
    """``(id, super_id)``: the smallest fire of each component of fires that share a tile-day.

    Two fires meet on a tile-day, so the tile-days are the graph: each fire links its first one with its others, and only those
    links that differ are kept. There are as many vertices as tile-days with several fires, however many fires meet there.
    """
    parts = [F.col(TILE_DAY[0]).cast("string"), *[x for c in TILE_DAY[1:] for x in (F.lit("|"), F.col(c).cast("string"))]]
    named = fires.where("id IS NOT NULL").select("id", F.concat(*parts).alias("day"))  # NULL without a tile or a day
    held = cut_lineage(named.groupBy("id").agg(F.collect_set("day").alias("days")), "fire-days")
    days = held.select("id", F.explode("days").alias("day"))
    shared = cut_lineage(days.groupBy("day").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("day"), "shared-days")
    met = days.join(shared, "day", "left_semi").groupBy("id").agg(F.min("day").alias("first"), F.collect_list("day").alias("days"))
    met = cut_lineage(met, "met")
    edges = met.select(F.col("first").alias("u"), F.explode("days").alias("v")).where("u <> v").distinct()
    components = connected_components(met.select(F.col("first").alias("id")), edges)
    component_of = components.select(F.col("id").alias("first"), F.col("super_id").alias("_c"))
    placed = cut_lineage(salted_join(met.select("id", "first"), component_of, ["first"], F.col("id")).select("id", "_c"), "placed")
    least = placed.groupBy("_c").agg(F.min("id").alias("super_id"))
    labels = salted_join(placed, least, ["_c"], F.col("id")).select("id", "super_id")
    return held.select("id").join(labels, "id", "left").withColumn("super_id", F.coalesce("super_id", "id"))


def extend_components(labels: DataFrame, vertices: DataFrame, edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """Rows ``(id, super_id)`` that a batch of vertices and edges adds to ``labels`` or changes there.

    The edges are contracted onto the labels they meet, so only the components of the batch form a graph; the
    vertices known before are read for their labels, never sent round again. A label can only become smaller:
    ``current_labels`` over old and returned rows is the partition of all edges so far.
    """
    ends = vertices.select("id").unionByName(edges.select(F.col("u").alias("id"))).unionByName(edges.select(F.col("v").alias("id")))
    known = labels.select("id", F.col("super_id").alias("_root"))
    met = cut_lineage(ends.distinct().join(known, "id", "left").select("id", "_root", F.coalesce("_root", "id").alias("root")), "met")
    root_of = lambda end: met.select(F.col("id").alias(end), F.col("root").alias(f"r{end}"))
    quotient = salted_join(edges.select("u", "v"), root_of("u"), ["u"], F.col("v"), salts=salts)
    quotient = salted_join(quotient, root_of("v"), ["v"], F.col("u"), salts=salts)
    pairs = quotient.where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
    merged = cut_lineage(connected_components(met.select(F.col("root").alias("id")), pairs, salts), "merged")
    to = merged.select(F.col("id").alias("root"), F.col("super_id").alias("to"))
    added = salted_join(met.where("_root IS NULL"), to, ["root"], F.col("id"), salts=salts)
    moved = salted_join(known.withColumnRenamed("_root", "root"), to.where("root <> to"), ["root"], F.col("id"), salts=salts)
    return added.select("id", F.col("to").alias("super_id")).unionByName(moved.select("id", F.col("to").alias("super_id")))


def current_labels(history: DataFrame) -> DataFrame:
    """The label of each id among the rows that batches have returned: the smallest, as components only grow."""
    return history.groupBy("id").agg(F.min("super_id").alias("super_id"))
