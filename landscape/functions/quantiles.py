"""Exact quantiles of many groups by rank selection.

``linear`` is NumPy's default (and DuckDB's ``quantile_cont``); ``nearest``
picks the element at 0-based rank ``floor((n - 1) * q + 0.5)`` of the sorted
group. ``selected`` computes either for all groups in one pass, without one
task holding a group:

1. Rows become counts per (group, value), spread over tasks by both.
2. A group with more than ``LARGE`` distinct values gets range bounds from a
   sketch. Any bounds give the exact result; good ones give even ranges.
3. A histogram of counts per (group, range) tells which ranges hold the wanted
   ranks and how many rows lie before them.
4. Only those ranges are kept; each is ordered on its own.

``percentile`` is Spark's exact aggregate, one value -> count map per group, for
groups whose number of distinct values is bounded otherwise (topics of a document).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE = 20_000  # distinct values from which a group is cut into ranges
RANGES = 64


def percentile(col: str | Column, q: float) -> Column:
    return F.percentile(F.col(col) if isinstance(col, str) else col, F.lit(q))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys included."""
    other = right.select(*[F.col(k).alias(f"{k}__") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    return left.join(other, cond, how).drop(*[f"{k}__" for k in keys])


def ranges(df: DataFrame, keys: Sequence[str], value: str, large: int = LARGE, pieces: int = RANGES) -> DataFrame:
    """(keys, value, _c, _n, _s, _r): counts per (group, value), the group's rows and
    sum (null where the group isn't cut), and the value's range in its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    at = [i / pieces for i in range(1, pieces)]
    # of groups that are cut, summed as decimals: the order of tasks doesn't move a mean
    total = (F.col(value) * F.col("_c")).cast("decimal(38,12)")
    group = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(total).alias("_s"),
                                      F.count("*").alias("_d"), F.percentile_approx(value, at, 1000).alias("_cuts"))
    group = group.withColumn("_cuts", F.when(F.col("_d") > large, F.array_distinct("_cuts")))
    group = group.withColumn("_s", F.when(F.col("_cuts").isNotNull(), F.col("_s").cast("double"))).drop("_d")
    below = F.size(F.filter("_cuts", lambda x: x < F.col(value)))
    return (_same(counts, group, keys)
            .withColumn("_r", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(below)).drop("_cuts"))


def selected(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], how: str = "nearest",
             mean: str | None = None, large: int = LARGE) -> DataFrame:
    """One row per group with a column per named quantile (and the mean under the
    name ``mean``, when given). Groups without a value are left out."""
    keys = list(keys)
    placed = ranges(df, keys, value, large)
    last = F.col("_n") - 1

    def ends(q: float) -> list[Column]:
        """The 0-based ranks a quantile is made of."""
        if how == "nearest":
            return [F.floor(last * F.lit(q) + F.lit(0.5))]
        return [F.floor(last * F.lit(q)), F.ceil(last * F.lit(q))]

    ranks = [r for q in qs.values() for r in ends(q)]

    def holds(r: Column, lo: str, many: str) -> Column:
        return (F.col(lo) <= r) & (r < F.col(lo) + F.col(many))

    histogram = placed.groupBy(*keys, "_r").agg(F.sum("_c").alias("_h"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    histogram = histogram.withColumn("_before", F.coalesce(F.sum("_h").over(before), F.lit(0)))
    wanted = holds(ranks[0], "_before", "_h")
    for r in ranks[1:]:
        wanted = wanted | holds(r, "_before", "_h")
    needed = histogram.where(wanted).select(*keys, "_r", "_before")
    within = Window.partitionBy(*keys, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ordered = _same(placed, needed, [*keys, "_r"]).withColumn(
        "_lo", F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)))

    def at(r: Column) -> Column:
        return F.max(F.when(holds(r, "_lo", "_c"), F.col(value)))

    group = ordered.groupBy(*keys)
    # a group that isn't cut is here whole, and summed in the order of its values
    total = F.coalesce(F.max("_s"), F.sum(F.col(value) * F.col("_c")))
    if how == "nearest":
        return group.agg(*[at(*ends(q)).alias(n) for n, q in qs.items()],
                         *([(total / F.max("_n")).alias(mean)] if mean else []))
    parts = group.agg(F.max("_n").alias("_n"), total.alias("_s"),
                      *[at(r).alias(f"{n}__{i}") for n, q in qs.items() for i, r in enumerate(ends(q))])

    def between(n: str, q: float) -> Column:
        pos, (lo, hi) = last * F.lit(q), ends(q)
        low, high = F.col(f"{n}__0"), F.col(f"{n}__1")
        return F.when(lo == hi, low).otherwise((hi - pos) * low + (pos - lo) * high)

    return parts.select(*keys, *[between(n, q).alias(n) for n, q in qs.items()],
                        *([(F.col("_s") / F.col("_n")).alias(mean)] if mean else []))


def nearest(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float],
            mean: str | None = None) -> DataFrame:
    return selected(df, keys, value, qs, "nearest", mean)


def with_quantiles(base: DataFrame, df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float],
                   how: str = "linear") -> DataFrame:
    """``base``, a row per group of ``df``, with the groups' quantiles (null without a value)."""
    return _same(base, selected(df, keys, value, qs, how), list(keys), "left")


def quartiles(df: DataFrame, keys: Sequence[str], value: str, prefix: str,
              interpolation: str = "nearest") -> DataFrame:
    """``{prefix}25/50/75`` and ``{prefix}_mean`` per group."""
    qs = {f"{prefix}25": 0.25, f"{prefix}50": 0.5, f"{prefix}75": 0.75}
    return selected(df, keys, value, qs, interpolation, mean=f"{prefix}_mean")
