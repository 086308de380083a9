"""Column helpers that stay in the JVM: estimators, distances, unsigned order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_MIN = -(1 << 63)


def unsigned(c: Column) -> Column:
    """A signed long whose order is the unsigned order of ``c``; applied twice it gives ``c``."""
    return c.bitwiseXOR(F.lit(_MIN))


def to_double(c: Column) -> Column:
    """The unsigned value as a double, correctly rounded."""
    half = F.shiftrightunsigned(c, 1).bitwiseOR(c.bitwiseAND(F.lit(1)))
    return F.when(c >= 0, c.cast("double")).otherwise(half.cast("double") * 2)


def is_empty(sig: Column) -> Column:
    """True for the signature of an empty set."""
    return F.forall(sig, lambda v: v == -1)


def jaccard(a: Column, b: Column) -> Column:
    """Share of equal slots; an error for signatures of unequal or no length."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    wrong = F.raise_error(F.concat(F.lit("signatures of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" slots"))).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(wrong)


def union_signature(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: unsigned(F.least(unsigned(x), unsigned(y))))


def cardinality(sig: Column) -> Column:
    """Estimated size of the set, 0 for the empty one; slots are added in their order."""
    total = F.aggregate(sig, F.lit(0.0), lambda s, v: s + to_double(v) / F.lit(18446744073709551616.0))
    return F.when(is_empty(sig), 0.0).otherwise(F.size(sig) / total - 1)


def intersection_cardinality(a: Column, b: Column) -> Column:
    j = jaccard(a, b)
    return j / (j + 1) * (cardinality(a) + cardinality(b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a in b, within [0, 1]; 0 for an empty a."""
    share = intersection_cardinality(a, b) / cardinality(a)
    return F.when(cardinality(a) <= 0, 0.0).otherwise(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard estimate, but 0 if either text has no shingles."""
    return F.when(is_empty(a) | is_empty(b), 0.0).otherwise(jaccard(a, b))


def text_containment(a: Column, b: Column) -> Column:
    return F.when(is_empty(a) | is_empty(b), 0.0).otherwise(containment(a, b))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def cosine_estimate(a: Column, b: Column) -> Column:
    return F.cos(distance(a, b) * F.lit(math.pi / 64))


def threshold(bands: int, rows: int) -> float:
    """Similarity at which a pair is about as likely found as missed."""
    if bands <= 0 or rows <= 0:
        raise ValueError("bands and rows must be positive")
    return (1 / bands) ** (1 / rows)


def params(k: int, target: float) -> tuple[int, int]:
    """(bands, rows) with bands * rows = k whose threshold is closest to the target; of equals the one with more bands."""
    if k <= 0 or not 0 < target < 1:
        raise ValueError("k must be positive and the target within (0, 1)")
    return min(((b, k // b) for b in range(k, 0, -1) if k % b == 0), key=lambda x: abs(threshold(*x) - target))


@dataclass(frozen=True)
class Config:
    """Shingle width, slots, seed and, for banding, bands and rows (both or neither)."""

    w: int = 3
    k: int = 128
    seed: int = 0
    bands: int = 16
    rows: int = 8

    def __post_init__(self):
        if self.w <= 0:
            raise ValueError("w must be positive")
        if not 0 < self.k <= 65535:
            raise ValueError("k must be in [1, 65535]")
        if (self.bands or self.rows) and (self.bands < 0 or self.rows < 0 or self.bands * self.rows != self.k):
            raise ValueError("bands * rows must be k")
