"""Scores, decisions, encodings and keyed hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    """Logistic function in the form that never overflows."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def argmax(scores: list[Column]) -> Column:
    """Index of the largest score, first one on ties."""
    packed = F.array(*scores)
    return (F.array_position(packed, F.array_max(packed)) - 1).cast("int")


def new_fire_probability(scores: list[Column]) -> Column:
    """Probability of the new-fire class: class 2 of three, class 1 of two."""
    return softmax(scores)[2 if len(scores) == 3 else 1]


def decide(p: Column, threshold: float, inclusive: bool) -> Column:
    return p >= F.lit(threshold) if inclusive else p > F.lit(threshold)


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def age_embedding(delta_t: Column, dim: int = 16) -> Column:
    """Sinusoidal age features: ``dim/2`` sines followed by as many cosines."""
    half = dim // 2
    freqs = [math.exp(-i * math.log(10000.0) / (half - 1)) for i in range(half)]
    return F.array(
        *[F.sin(delta_t * F.lit(f)) for f in freqs],
        *[F.cos(delta_t * F.lit(f)) for f in freqs],
    )


def position_encoding(pos: Column, d: int, period: float = 1000.0, repeat: int = 1) -> Column:
    """Sine on even, cosine on odd components, the block repeated ``repeat`` times."""
    block = []
    for i in range(d):
        angle = pos / F.lit(period ** (2 * (i // 2) / d))
        block.append(F.sin(angle) if i % 2 == 0 else F.cos(angle))
    return F.array(*(block * repeat))


def stable_seed(*parts: Column) -> Column:
    """32-bit seed of a list of values: low four bytes, little endian, of a SHA-256 digest."""
    text = F.concat(*[piece for p in parts for piece in (p.cast("string"), F.lit("|"))])
    digest = F.sha2(text, 256)
    swapped = F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("bigint")


def order_hash(seed: int | str, *keys: Column) -> Column:
    """Keyed hash that stands in for a shuffle: the same rows come first on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in keys]))
