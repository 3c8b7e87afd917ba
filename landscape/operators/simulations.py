"""Taxonomy simulation runs (survey 2.A read_simulation_runs, 2.G run_topic_names,
2.K query_sizes / query_distances / pairwise_long).

A simulation run is a taxonomy built on a sample (or a noisy version) of the
data, stored as one parquet table per run whose name carries the ratio
(``..._sample_25_simul_0``). All runs are read in one scan; the run name and
ratio come from the file path, and every statistic uses ``run`` as a key
instead of looping over runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .validation import LEVELS, distances_to_mean, same_label_pairs

RUN_PATTERN = r"(?:ratio_|sample_)(\d{2,3})_"


def read_simulation_runs(spark, path: str) -> DataFrame:
    """(run, ratio, entity, Level_1..Level_5) for every stored run: folders ``run=<name>``,
    or files (or folders of files) whose own name is the run's, with or without
    ``.parquet`` (``path`` may be a pattern)."""
    df = spark.read.parquet(path).withColumn("_file", F.input_file_name())
    tagged = F.regexp_extract("_file", r"([^/=]*(?:ratio_|sample_)\d{2,3}_[^/]*?)(?:\.parquet)?(?:/[^/]*)?$", 1)
    run = F.coalesce(F.nullif(F.regexp_extract("_file", r"run=([^/]+)", 1), F.lit("")), tagged)
    return df.select(run.alias("run"), F.regexp_extract(run, RUN_PATTERN, 1).alias("ratio"), "entity",
                     *[f"Level_{i}" for i in LEVELS])


def _unpivot(runs: DataFrame, levels: Sequence[int]) -> DataFrame:
    return runs.select("run", "ratio", "entity", F.inline(F.array(*[
        F.struct(F.lit(f"Level_{i}").alias("level"), F.col(f"Level_{i}").alias("topic")) for i in levels])))


def query_sizes(runs: DataFrame, names: DataFrame, ratios: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """Topic sizes of the selected runs and levels; with several ratios the
    level label gets a ``_ratio_<r>`` suffix; missing names become "No Name"."""
    r = runs.where(F.col("ratio").isin(list(ratios)))
    sizes = _unpivot(r, levels).groupBy("run", "ratio", "level", "topic").agg(F.count("*").alias("size"))
    lvl = F.concat(F.col("level"), F.lit("_ratio_"), F.col("ratio")) if len(ratios) > 1 else F.col("level")
    nm = names.select(F.concat(F.lit("Level_"), F.col("level").cast("string")).alias("level"), "topic",
                      F.col("name").alias("TopicName"))
    return (sizes.join(nm, ["level", "topic"], "left")
            .select("run", "ratio", lvl.alias("level"), "topic", "size",
                    F.coalesce("TopicName", F.lit("No Name")).alias("TopicName")))


def query_distances(runs: DataFrame, embeddings: DataFrame, ratios: Sequence[str], levels: Sequence[int],
                    entities: Sequence[str] | None = None) -> DataFrame:
    """Entity-to-topic-centroid distances per run and level, optionally only
    for entities matching any of the given names (case-insensitive)."""
    r = runs.where(F.col("ratio").isin(list(ratios)))
    d = distances_to_mean(_unpivot(r, levels), embeddings, ["run", "ratio", "level", "topic"])
    if entities:
        d = d.where(F.col("entity").rlike("(?i)" + "|".join(entities)))
    return d


def run_topic_names(runs: DataFrame, mentions: DataFrame, levels: Sequence[int] = LEVELS,
                    num_entities: int = 10) -> DataFrame:
    """Entity-count names of every topic of every run and level at once."""
    counts = mentions.groupBy("entity").agg(F.count("*").alias("count"))
    lc = _unpivot(runs, levels).join(counts, "entity")
    w = Window.partitionBy("run", "level", "topic").orderBy(F.col("count").desc(), "entity")
    top = lc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= num_entities)
    return (top.groupBy("run", "level", "topic")
            .agg(F.array_sort(F.collect_list(F.struct("_rn", "entity"))).alias("_l"))
            .select("run", "level", "topic", F.array_join(F.transform("_l", lambda s: s["entity"]), ", ").alias("name")))


def pairwise_long(runs: DataFrame, groups: DataFrame, keys: Sequence[str] = ("area", "discipline")) -> DataFrame:
    """Per run, group (``keys`` may go down to subtopics) and level: share of the
    group's entity pairs in the same topic, from label counts."""
    g = groups.select(*keys, "entity").distinct()
    long = _unpivot(runs, LEVELS).join(g, "entity")
    shares = same_label_pairs(long, ["run", "ratio", *keys, "level"], "topic").where("pairs > 0")
    return shares.select("run", "ratio", *keys, "level", (F.col("same") / F.col("pairs")).alias("prop"))
