"""Statistics as states that merge: moments, extremes and a quantile sketch per feature and day."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.values import finite_or_null, valid_or_null

#: Buckets of the sketch grow by this factor, so a quantile is off by at most one per cent.
GROWTH = 1.02
#: Values nearer to zero than this are one bucket.
LEAST = 1e-9

MOMENTS = ("n", "mean", "m2", "min", "max")


def bucket_of(v: Column) -> Column:
    """Bucket number of a value: monotone, 0 around zero, symmetric in sign."""
    size = F.ceil(F.ln(F.abs(v) / F.lit(LEAST)) / F.lit(math.log(GROWTH)))
    return F.when(F.abs(v) <= LEAST, 0).otherwise(F.when(v > 0, size).otherwise(-size)).cast("int")


def value_of(bucket: Column) -> Column:
    """Middle of a bucket, relative to which its values lie within one per cent."""
    middle = F.lit(LEAST) * F.pow(F.lit(GROWTH), F.abs(bucket).cast("double")) * F.lit(2 / (1 + GROWTH))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, middle).otherwise(-middle)


def _merged(states: Column) -> Column:
    """One state from an array of states (n, mean, m2, min, max), added pair by pair in the order of the array."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
        F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
    )

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"),
            F.least(a["min"], b["min"]).alias("min"), F.greatest(a["max"], b["max"]).alias("max"),
        )

    return F.aggregate(states, zero, add)


def merge_states(states: DataFrame, *keys: str) -> DataFrame:
    """States of equal ``keys`` as one: moments by pairwise addition, sketches by adding the counts of equal buckets.

    A sketch has some thousand buckets at most, whatever it counts, and states are few per key (one per day); both are
    sorted first, so the result does not depend on the order of arrival.
    """
    moments = states.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*MOMENTS))).alias("_s")).select(*keys, _merged(F.col("_s")).alias("_m"))
    counts = states.select(*keys, F.explode("sketch").alias("_b")).groupBy(*keys, F.col("_b.bucket").alias("bucket")).agg(F.sum("_b.n").alias("n"))
    sketch = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("sketch"))
    return moments.join(sketch, list(keys)).select(*keys, "_m.*", "sketch")


def day_states(pixels: DataFrame, features: list[str], day: str = "day", nodata: float | None = None) -> DataFrame:
    """One state per ``day`` and feature from the pixels of these days; missing and infinite values do not count.

    Pixels are folded to buckets before the shuffle; a bucket is itself a state, so the day's moments are merged from its buckets.
    """
    named = F.array(*[F.struct(F.lit(f).alias("feature"), finite_or_null(valid_or_null(F.col(f).cast("double"), nodata)).alias("v")) for f in features])
    long = pixels.select(F.col(day).alias("day"), F.inline(named)).where("v IS NOT NULL")
    buckets = long.groupBy("day", "feature", bucket_of(F.col("v")).alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("_var"), F.min("v").alias("min"), F.max("v").alias("max")
    ).withColumn("m2", F.col("_var") * F.col("n"))
    entry = F.struct("bucket", *MOMENTS)
    held = buckets.groupBy("day", "feature").agg(F.sort_array(F.collect_list(entry)).alias("_s"))
    bare = F.transform("_s", lambda s: F.struct(*[s[c].alias(c) for c in MOMENTS]))
    return held.select(
        "day", "feature", _merged(bare).alias("_m"), F.transform("_s", lambda s: F.struct(s["bucket"].alias("bucket"), s["n"].alias("n"))).alias("sketch")
    ).select("day", "feature", "_m.*", "sketch")


def quantile(q: float, sketch: Column | None = None) -> Column:
    """The value at rank floor(q * (n - 1)) of a sketch (ordered buckets), to within one per cent."""
    sketch = F.col("sketch") if sketch is None else sketch
    total = F.aggregate(sketch, F.lit(0).cast("bigint"), lambda a, b: a + b["n"])
    rank = F.floor(F.lit(q) * (total - 1))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("bucket"))

    def step(a: Column, b: Column) -> Column:
        seen = a["seen"] + b["n"]
        return F.struct(seen.alias("seen"), F.when(a["bucket"].isNull() & (seen > rank), b["bucket"]).otherwise(a["bucket"]).alias("bucket"))

    return value_of(F.aggregate(sketch, start, step)["bucket"])


def summary(states: DataFrame) -> DataFrame:
    """Statistics of merged states in the form of ``feature_stats``, with the median."""
    return states.select(
        "feature", "mean", (F.sqrt(F.col("m2") / F.col("n")) + 1e-8).alias("std"), "min", "max", F.col("n").alias("count"), quantile(0.5).alias("median")
    )
