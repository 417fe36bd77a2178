"""Equality within a relative tolerance as a hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative tolerance of two canonical numbers, with a floor of 1 for their size.
TOLERANCE = 1e-9


def within(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def bucket(x: Column, tolerance: float = TOLERANCE) -> Column:
    """A bucket number; values within the tolerance are at most one bucket apart.

    The scale is linear up to 1 and logarithmic beyond, so a step of the tolerance is at most a step of the same size.
    """
    size = F.abs(x)
    scaled = F.when(size <= 1, x).otherwise(F.signum(x) * (1 + F.ln(F.greatest(size, F.lit(1.0)))))
    return F.floor(scaled / (10 * tolerance)).cast("long")


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """Inner join of rows whose numbers are equal within the tolerance and whose ``keys`` are equal.

    The left side, the smaller one, is copied to the three buckets around its own; each match lies in exactly one of
    them. Null numbers match nothing. A popular number makes one large bucket, which adaptive skew joins split. Columns
    of the two sides must not share names, but for ``keys``.
    """
    near = F.explode(F.array(*(bucket(F.col(left_on), tolerance) + d for d in (-1, 0, 1))))
    a = left.where(F.col(left_on).isNotNull()).withColumn("__bucket", near)
    b = right.where(F.col(right_on).isNotNull()).withColumn("__bucket", bucket(F.col(right_on), tolerance))
    return a.join(b, [*keys, "__bucket"]).where(within(F.col(left_on), F.col(right_on), tolerance)).drop("__bucket")
