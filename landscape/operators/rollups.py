"""Hierarchical roll-ups for sunburst charts (survey 2.M).

One ``rollup`` over the path columns yields every prefix of every path with
its summed value in a single aggregation; ``grouping_id`` tells how deep a
row is. Each row gets an id (the path joined by " - "), a label (its last
element) and a parent id (the path without its last element).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEP = " - "


def rollup_paths(df: DataFrame, path: Sequence[str], value: str = "count") -> DataFrame:
    path = list(path)
    g = df.rollup(*path).agg(F.sum(value).alias("value"), F.grouping_id().alias("_gid"))
    g = g.where(F.col("_gid") != (1 << len(path)) - 1)  # drop the grand total
    # depth = number of path columns that are grouped (not rolled up)
    depth = sum((F.col("_gid").bitwiseAND(F.lit(1 << (len(path) - 1 - i))) == 0).cast("int") for i in range(len(path)))
    parts = F.slice(F.array(*[F.col(c).cast("string") for c in path]), 1, depth)
    return (g.withColumn("_depth", depth)
            .withColumn("_parts", parts)
            .select(F.array_join("_parts", SEP).alias("id"),
                    F.element_at("_parts", -1).alias("label"),
                    F.when(F.col("_depth") > 1,
                           F.array_join(F.slice("_parts", 1, F.col("_depth") - 1), SEP)).otherwise(F.lit("")).alias("parent"),
                    F.col("_depth").alias("depth"), "value"))


def named_paths(ejl: DataFrame, names: dict[int, DataFrame]) -> DataFrame:
    """Replace Level_i ids by names where a name exists."""
    out = ejl
    for lv, nm in names.items():
        out = (out.join(nm.select(F.col("topic").alias(f"Level_{lv}"), F.col("name").alias(f"_n{lv}")),
                        f"Level_{lv}", "left")
               .withColumn(f"Level_{lv}", F.coalesce(f"_n{lv}", f"Level_{lv}")).drop(f"_n{lv}"))
    return out


def _chosen(ejl: DataFrame, entities: DataFrame | None, cluster: str | None,
            names: dict[int, DataFrame] | None) -> DataFrame:
    """Rows of the listed entities and of one first-level cluster, ids named."""
    if entities is not None:
        ejl = ejl.join(entities.select("entity"), "entity", "left_semi")
    if cluster is not None:
        ejl = ejl.where(F.col("Level_1") == cluster)
    return named_paths(ejl, names) if names else ejl


def rollup_topic_entity(ejl: DataFrame, levels: int = 2, with_journal: bool = False,
                        names: dict[int, DataFrame] | None = None, entities: DataFrame | None = None,
                        cluster: str | None = None) -> DataFrame:
    path = [f"Level_{i}" for i in range(1, levels + 1)] + ["entity"] + (["journal"] if with_journal else [])
    return rollup_paths(_chosen(ejl, entities, cluster, names), path)


def rollup_entity_journal(ejl: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    return rollup_paths(_chosen(ejl, entities, None, None), ["entity", "journal"])


def rollup_journal_topic(ejl: DataFrame, main: DataFrame, levels: int = 2, journal: str | None = None,
                         names: dict[int, DataFrame] | None = None) -> DataFrame:
    d = _chosen(ejl, None, None, names).join(main.select("journal"), "journal", "left_semi")
    if journal is not None:
        d = d.where(F.col("journal") == journal)
    return rollup_paths(d, ["journal"] + [f"Level_{i}" for i in range(1, levels + 1)] + ["entity"])


def main_entities(ejl: DataFrame, ns: Sequence[int] = (10, 25, 50)) -> DataFrame:
    """Top-N entities by summed count for several N in one pass."""
    tot = ejl.groupBy("entity").agg(F.sum("count").alias("total"))
    # top-k first (a partial sort per partition), then rank the <= max(ns) survivors
    top = (tot.orderBy(F.col("total").desc(), "entity").limit(max(ns))
           .withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "entity"))))
    return top.select("entity", "total", "rank",
                      *[(F.col("rank") <= n).alias(f"top_{n}") for n in ns])
