"""Order-independent means rounded to 6 decimals.

Floating-point sums depend on summation order, which differs between runs
and engines; when the exact mean lies on a rounding tie the 6th decimal
flips. Here values with at most ``scale`` decimals are summed as integers
(exact) and the single division is rounded half away from zero in integer
arithmetic, so every engine and partitioning gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean6(value: str | Column, weight: str | Column | None = None, scale: int = 3) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    k = F.round(v * F.lit(10 ** scale)).cast("bigint")
    if weight is None:
        s, n = F.sum(k), F.count(k)
    else:
        w = F.col(weight) if isinstance(weight, str) else weight
        s, n = F.sum(k * w), F.sum(F.when(v.isNotNull(), w))
    num = F.lit(2) * F.abs(s) * F.lit(10 ** (6 - scale)) + n
    return (F.signum(s) * F.floor(num / (F.lit(2) * n)) / F.lit(1e6)).cast("double")
