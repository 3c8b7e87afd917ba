"""Unordered pairs of items that share a group (document, label, ...).

Used where the pairs *are* the operator's output (topic pairs of a work,
co-mentioned entities, co-authoring organisations). Input rows must already
be distinct on (group, item), which bounds a group by its number of distinct
items.

Hot groups are split: a group with more than ``chunk`` items is cut into
``ceil(n / chunk)`` salt buckets on the left side (by a hash of the item)
while the right side is replicated once per bucket, so one hot group becomes
many join tasks instead of one. Ordinary groups get a single bucket and pay
nothing extra. The hot-group table is one row per hot group; the planner
broadcasts it only when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHUNK = 2000


def pairs_within(df: DataFrame, groups: Sequence[str], item: str,
                 first: str = "item_1", second: str = "item_2",
                 carry: Sequence[str] = (), chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Rows (groups..., carry..., first, second) with first < second.

    ``carry`` columns must be functionally dependent on the group (they are
    taken from the left side).
    """
    groups, carry = list(groups), list(carry)
    base = df.select(*groups, *carry, item)
    hot = (base.groupBy(*groups).agg(F.count("*").alias("_n"))
           .where(F.col("_n") > chunk)
           .select(*groups, F.ceil(F.col("_n") / F.lit(chunk)).cast("int").alias("_ns")))
    sized = (base.join(hot, groups, "left")
             .withColumn("_ns", F.coalesce(F.col("_ns"), F.lit(1))))
    left = sized.select(*groups, *carry, F.col(item).alias(first),
                        F.pmod(F.xxhash64(item), F.col("_ns")).cast("int").alias("_salt"))
    right = sized.select(*groups, F.col(item).alias(second),
                         F.explode(F.sequence(F.lit(0), F.col("_ns") - 1)).alias("_salt"))
    return (left.join(right, groups + ["_salt"])
            .where(F.col(first) < F.col(second))
            .select(*groups, *carry, first, second))
