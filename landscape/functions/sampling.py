"""Deterministic samples.

A row is kept when a seeded hash of its id falls below the fraction. The hash
is the head of an MD5 digest, which every SQL engine has, so that a sample can
be drawn again outside Spark.
Unlike ``DataFrame.sample`` the draw does not depend on partitioning or
task retries, so a lost executor recomputes exactly the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_hash(col: str | Column, seed: int = 0) -> Column:
    """A value in [0, 1) derived from the column and the seed."""
    c = F.col(col) if isinstance(col, str) else col
    head = F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(1 << 32))


def hash_sample(df: DataFrame, col: str, fraction: float | Column, seed: int = 0) -> DataFrame:
    frac = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return df.where(unit_hash(col, seed) < frac)
