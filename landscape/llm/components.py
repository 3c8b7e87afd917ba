"""Connected components of an edge table by alternating large-star and
small-star rounds. Every round is one grouped minimum and one join, written
to the shared checkpoint folder; only a count and a checksum reach the
driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _with_lowest(near: DataFrame, low: DataFrame) -> DataFrame:
    """Rows of ``near`` with the smallest neighbour ``m`` of their node. ``low`` is
    a table of its own, so that AQE can split the rows of a hub (it can't where
    the join shares the grouping's shuffle)."""
    return near.join(low, "u")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) edges."""
    both = edges.select("u", "v")
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:  # all neighbours; the larger ones are handed to the smallest
        near = both.unionByName(flipped)
        low = stage(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        handed = _with_lowest(near.filter("v > u"), low)
        return handed.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    # small: only neighbours not larger; they and the node go to the smallest
    near = both.filter("v < u").unionByName(flipped.filter("v < u"))
    low = stage(near.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    handed = _with_lowest(near, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (u, v) edge table; the
    component is its smallest node. Loops, repeated and reversed edges are
    allowed; rows with a null end are ignored; no edges give no rows."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .filter("u IS NOT NULL AND v IS NOT NULL"), "edges")
    loops = now.filter("u = v").select("u").distinct()
    now_edges = now.filter("u <> v").distinct()
    mark = None
    while True:
        now_edges = stage(_star(_star(now_edges, True), False), "stars")
        new = _mark(now_edges)
        if new == mark or not new[0]:
            break
        mark = new
    # a fixpoint is a set of stars: every edge leads from a node to its smallest
    roots = now_edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    lone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return (now_edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots).unionByName(lone)
            .groupBy("node").agg(F.min("component").alias("component")))
