"""Exact ranks, running sums and quantiles without a single-task window.

A window without partition columns (or with a handful of label partitions) sends everything to
one task.  These operators cut the order into buckets, add up the buckets, and finish inside
each bucket, so the only unpartitioned window runs over the bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.session import cut_lineage

ROWS_PER_BUCKET = 1 << 20  # rows that one window task sorts, about
LEVEL_BITS = 8  # bits of the bucket number that one set of bounds decides
HASH_DIGITS = 4  # leading hex digits of a hash that make its bucket: 10^12 rows leave about 15 million in each


def bucket_bits(rows: int) -> int:
    """Bits of the bucket number, so that the buckets grow with the data and their size does not."""
    return max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length()


def _with_range_bucket(df: DataFrame, order: str, bits: int, group: list[str]) -> DataFrame:
    """Add ``_bucket``: number of approximate quantile bounds not above the value.

    The order is refined level by level: at most ``2**LEVEL_BITS - 1`` bounds are taken from all rows (per group, of
    which there are few: models, say), then as many inside each bucket, and so on. So a sketch of quantiles has
    the same size however many rows there are; only the number of sketches grows. Any bounds give exact
    results. The lookup is an unrolled binary search, one comparison per bit.
    """
    out = df.withColumn("_bucket", F.lit(0))
    done = 0
    while done < bits:
        step = min(LEVEL_BITS, bits - done)
        out = _refined(out, order, step, [*group, "_bucket"] if done else group)
        done += step
    return out


def _refined(df: DataFrame, order: str, bits: int, within: list[str]) -> DataFrame:
    """Split each bucket in ``2**bits`` by bounds taken ``within`` it."""
    n = 2**bits
    bounds = F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n).alias("_bounds")
    if within:
        out = df.join(df.groupBy(*within).agg(bounds), within)
    else:
        out = df.withColumn("_bounds", df.select(bounds).scalar())
    out = out.withColumn("_local", F.lit(0))
    for step in (2**b for b in reversed(range(bits))):
        probe = F.element_at("_bounds", F.col("_local") + F.lit(step))
        out = out.withColumn("_local", F.col("_local") + F.when(probe <= F.col(order), F.lit(step)).otherwise(F.lit(0)))
    return out.withColumn("_bucket", F.col("_bucket") * n + F.col("_local")).drop("_local", "_bounds")


def running_sums(
    grouped: DataFrame, order: str, sums: dict[str, str], descending: bool = False,
    bits: int | None = None, group: list[str] | None = None,
) -> DataFrame:
    """Running sums of ``sums`` (input -> output column) over a numeric ``order`` column.

    ``order`` must be unique (per ``group``): aggregate by it first, which also folds a value held
    by many rows into one.  The rows are written once (they are read for the bounds, the totals and
    the result), and their number decides how many buckets there are unless ``bits`` does.
    """
    group = group or []
    grouped = cut_lineage(grouped, "running-sums")
    bits = bucket_bits(grouped.count()) if bits is None else bits
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    tagged = _with_range_bucket(grouped, order, bits, group)
    before = Window.partitionBy(*group).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(
        *group, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )  # at most 2**bits rows per group
    inside = Window.partitionBy(*group, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(offsets, [*group, "_bucket"])
    out = out.withColumns({new: F.col(f"_o_{c}") + F.sum(c).over(inside) for c, new in sums.items()})
    return out.drop("_bucket", *[f"_o_{c}" for c in sums])


def exact_quantiles(
    df: DataFrame, value: str, probs: tuple[float, ...] | list[float]
) -> DataFrame:
    """One row ``(q ARRAY<DOUBLE>)`` of linearly interpolated quantiles, exact at any size.

    Values are counted, ranked by running sums, and only the two order statistics around each
    quantile are kept.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(
        F.count("*").alias("_n")
    )
    ranked = running_sums(counted, "_v", {"_n": "_to"})
    total = df.agg(F.count(value).alias("n")).scalar()

    def at(p: float, side: str) -> Column:
        position = F.lit(float(p)) * (F.col("_total") - 1)
        rank = (F.floor(position) if side == "lo" else F.ceil(position)) + 1
        return F.max(F.when((F.col("_to") >= rank) & (F.col("_to") - F.col("_n") < rank), F.col("_v")))

    picked = ranked.withColumn("_total", total).agg(
        F.max("_total").alias("_total"),
        *[at(p, s).alias(f"_{s}{i}") for i, p in enumerate(probs) for s in ("lo", "hi")],
    )
    blend = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("_total") - 1)
        blend.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position - F.floor(position)))
    return picked.select(F.array(*blend).alias("q"))


def bin_by_quantiles(
    value: str, edges: Column, probs: tuple[float, ...], labels: tuple[str, ...]
) -> Column:
    """Right-closed bins between quantile edges; a repeated edge makes an empty bin."""
    label: Column = F.lit(labels[-1])
    for i in reversed(range(len(probs))):
        label = F.when(F.col(value) <= F.element_at(edges, F.lit(i + 1)), F.lit(labels[i])).otherwise(label)
    return F.when(F.col(value).isNotNull(), label)


def rank_by_hash(
    df: DataFrame, group: list[str], order_hash: Column, ties: list[str], out: str = "hash_rank", digits: int = HASH_DIGITS
) -> DataFrame:
    """``row_number() over (partition by group order by hash, ties)`` spread over hash buckets.

    The leading hex digits of the hash are the bucket; hashes of unique keys fill buckets evenly,
    so even a group with most of the rows is spread over ``16**digits`` window partitions.
    """
    tagged = df.withColumn("_hash", order_hash).withColumn("_b", F.substring("_hash", 1, digits))
    counts = tagged.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_b").orderBy("_hash", *ties)
    ranked = tagged.join(offsets, [*group, "_b"])
    return ranked.withColumn(out, F.col("_o") + F.row_number().over(inside)).drop("_hash", "_b", "_o")


def take_by_hash(
    df: DataFrame, group: list[str], order_hash: Column, ties: list[str], quota: Column, digits: int = HASH_DIGITS
) -> DataFrame:
    """The first ``quota`` rows per group in hash order; only rows of the cut bucket are sorted.

    What is joined is one row per group (class labels: a few), so the planner broadcasts it and rows beyond the
    quota are dropped before any shuffle.
    """
    tagged = df.withColumn("_hash", order_hash).withColumn("_b", F.substring("_hash", 1, digits))
    counts = tagged.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_b")
    begun = counts.select(*group, "_b", "_n", F.sum("_n").over(upto).alias("_to")).withColumn(
        "_room", quota - (F.col("_to") - F.col("_n"))
    )
    last = F.max(F.struct("_b", "_n", "_room")).alias("_cut")
    cuts = begun.where(F.col("_room") > 0).groupBy(*group).agg(last).select(
        *group, F.col("_cut._b").alias("_last"), F.col("_cut._n").alias("_n"), F.col("_cut._room").alias("_room")
    )
    joined = tagged.join(cuts, group).where(F.col("_b") <= F.col("_last"))
    open_ = (F.col("_b") == F.col("_last")) & (F.col("_n") > F.col("_room"))
    inside = Window.partitionBy(*group).orderBy("_hash", *ties)
    cut = joined.where(open_).withColumn("_rn", F.row_number().over(inside)).where(F.col("_rn") <= F.col("_room")).drop("_rn")
    return joined.where(~open_).unionByName(cut).drop("_hash", "_b", "_last", "_n", "_room")


def rank_by_prefix(df: DataFrame, prefix: list[str], order: list[str], out: str = "rank", group: list[str] | None = None) -> DataFrame:
    """Global row number (per ``group``) in the order ``prefix + order``, numbered per prefix value.

    The prefix should have few values compared with the rows (year and day, say); only the
    prefix totals are ordered as a whole.
    """
    group = group or []
    keys = [*group, *prefix]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    spec = Window.partitionBy(*group) if group else Window.partitionBy()
    before = spec.orderBy(*prefix).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.join(offsets, keys).withColumn(out, F.col("_o") + F.row_number().over(inside)).drop("_o")
