"""Taxonomy validation statistics (survey 2.K).

The taxonomy is unpivoted once to (entity, level, topic); every per-level
statistic is then one aggregation keyed by level rather than a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import pairs_within

LEVELS = (1, 2, 3, 4, 5)


def unpivot_levels(taxonomy: DataFrame, levels: Sequence[int] = LEVELS, carry: Sequence[str] = ()) -> DataFrame:
    return taxonomy.select(*carry, "entity", F.inline(F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic")) for i in levels])))


def topic_entity_counts(taxonomy: DataFrame) -> DataFrame:
    return unpivot_levels(taxonomy).groupBy("level", "topic").agg(F.count("*").alias("n"))


def tax_chisq(taxonomy: DataFrame) -> DataFrame:
    """Per level: chi-square statistic of entities per topic against uniform."""
    c = topic_entity_counts(taxonomy)
    w = Window.partitionBy("level")
    e = F.sum("n").over(w) / F.count("*").over(w)
    return (c.withColumn("_e", e).groupBy("level")
            .agg(F.sum(F.pow(F.col("n") - F.col("_e"), 2) / F.col("_e")).alias("chisq")))


def tax_kl_uniform(taxonomy: DataFrame) -> DataFrame:
    """Per level: KL(uniform || actual share of entities per topic), natural log."""
    c = topic_entity_counts(taxonomy)
    w = Window.partitionBy("level")
    k, n = F.count("*").over(w), F.sum("n").over(w)
    return (c.withColumn("_p", F.lit(1.0) / k).withColumn("_q", F.col("n") / n)
            .groupBy("level").agg(F.sum(F.col("_p") * F.log(F.col("_p") / F.col("_q"))).alias("kl")))


def tax_topic_counts(taxonomy: DataFrame) -> DataFrame:
    return unpivot_levels(taxonomy).groupBy("level").agg(F.countDistinct("topic").alias("n_topics"))


def tax_split_fraction(taxonomy: DataFrame) -> DataFrame:
    """Per level (but the last): share of its topics that are not also labels
    of the next level, i.e. that split."""
    lv = unpivot_levels(taxonomy).select("level", "topic").distinct()
    nxt = lv.select((F.col("level") - 1).alias("level"), "topic", F.lit(1).alias("_kept"))
    return (lv.where(F.col("level") < max(LEVELS)).join(nxt, ["level", "topic"], "left")
            .groupBy("level").agg((F.sum(F.when(F.col("_kept").isNull(), 1).otherwise(0)) / F.count("*"))
                                  .alias("split_fraction")))


def _grouped(taxonomy: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return groups.select(*keys, "entity").distinct().join(taxonomy, "entity")  # entities outside the taxonomy drop


def pairs_of(n: str) -> Column:
    """Unordered pairs of n things."""
    return F.shiftright(F.col(n) * (F.col(n) - 1), 1)


def same_label_pairs(long: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys, same, pairs) of rows (keys, item, label), an item once per key: how many
    pairs of items share the label, and how many there are. No pair is built: n
    items of one label are n (n - 1) / 2 pairs. Null labels are left out."""
    held = long.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    return (held.groupBy(*keys).agg(F.sum(pairs_of("_n")).alias("same"), F.sum("_n").alias("_n"))
            .select(*keys, "same", pairs_of("_n").alias("pairs")))


def pairwise_depth(taxonomy: DataFrame, groups: DataFrame, keys: Sequence[str] = ("area", "discipline")) -> DataFrame:
    """Per group of known related entities (``keys`` may go down to subtopics): mean
    over their pairs of the number of distinct labels the two share across levels.
    The sum over pairs is the sum over labels of the pairs that hold it."""
    g = _grouped(taxonomy, groups, keys)
    labels = g.select(*keys, "entity", F.explode(F.array_distinct(F.array(*[F.col(f"Level_{i}") for i in LEVELS]))).alias("label"))
    shared = (labels.groupBy(*keys, "label").agg(F.count("*").alias("_n"))
              .groupBy(*keys).agg(F.sum(pairs_of("_n")).alias("_sum")))
    sizes = g.groupBy(*keys).agg(F.count("*").alias("_m")).where("_m > 1")
    return sizes.join(shared, list(keys)).select(*keys, (F.col("_sum") / pairs_of("_m")).alias("depth"), pairs_of("_m").alias("n_pairs"))


def pairwise_survival(taxonomy: DataFrame, groups: DataFrame, keys: Sequence[str] = ("area", "discipline")) -> DataFrame:
    """Per group and level: share of the group's pairs that sit in the same topic."""
    long = unpivot_levels(_grouped(taxonomy, groups, keys), carry=keys)
    return (same_label_pairs(long, [*keys, "level"], "topic").where("pairs > 0")
            .select(*keys, "level", (F.col("same") / F.col("pairs")).alias("share_same_topic"), F.col("same").alias("pairs_same_topic")))


def surviving_pairs(taxonomy: DataFrame, groups: DataFrame, keys: Sequence[str] = ("area", "discipline")) -> DataFrame:
    """(keys, level, topic, entity_1, entity_2): the pairs that sit in the same topic;
    no others are built."""
    long = unpivot_levels(_grouped(taxonomy, groups, keys), carry=keys).where(F.col("topic").isNotNull())
    return pairs_within(long, [*keys, "level", "topic"], "entity", "entity_1", "entity_2")


def dropped_entities(taxonomy: DataFrame, groups: DataFrame, keys: Sequence[str] = ("area", "discipline")) -> DataFrame:
    """Group members that the taxonomy does not hold; the pair statistics leave them out."""
    return groups.select(*keys, "entity").distinct().join(taxonomy.select("entity"), "entity", "left_anti").select(*keys, "entity")


def topic_sizes(taxonomy: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per level and topic: entities, share of all entities (5 decimals), parent (first segment)."""
    c = topic_entity_counts(taxonomy)
    n = taxonomy.agg(F.count("*").alias("_N"))
    out = (c.crossJoin(n)  # one-row side
           .select("level", "topic", F.col("n").alias("size"),
                   F.round(F.col("n") / F.col("_N"), 5).alias("share"),
                   F.substring_index("topic", "_", 1).alias("parent")))
    if names is not None:
        out = out.join(names.select("level", "topic", "name"), ["level", "topic"], "left")
    return out


def distances_to_mean(labelled: DataFrame, embeddings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, entity, distance): Euclidean distance of each entity to the mean
    embedding of its group; NULL where the group has one embedding. Means are
    vector aggregations, so a row stays one row."""
    keys = list(keys)
    x = labelled.select(*keys, "entity").join(
        embeddings.select("entity", F.col("embedding").cast("array<double>").alias("v")), "entity")
    means = (x.groupBy(*keys).agg(Summarizer.mean(array_to_vector("v")).alias("m"), F.count("*").alias("_n"))
             .select(*keys, vector_to_array("m").alias("mu"), "_n"))
    squared = F.aggregate(F.zip_with("v", "mu", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return x.join(means, keys).select(*keys, "entity", F.when(F.col("_n") > 1, F.sqrt(squared)).alias("distance"))


def centroid_distances(taxonomy: DataFrame, embeddings: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Per level, the distance of every entity to the mean embedding of its topic."""
    return distances_to_mean(unpivot_levels(taxonomy, levels), embeddings, ["level", "topic"])


def distance_timeseries(distances: DataFrame, keys: Sequence[str] = ("level",)) -> DataFrame:
    return (distances.groupBy(*keys)
            .agg(F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("std"))
            .withColumn("upper", F.col("mean") + F.col("std"))
            .withColumn("lower", F.col("mean") - F.col("std")))


def entity_level_vector(taxonomy: DataFrame, width: int = 5) -> DataFrame:
    parts = F.split("Level_5", "_")
    return taxonomy.select("entity", *[
        F.coalesce(F.get(parts, i).cast("int"), F.lit(0)).alias(f"l{i + 1}") for i in range(width)])


def metrics_long(taxonomies: dict[str, DataFrame], groups: DataFrame | None = None,
                 keys: Sequence[str] = ("area", "discipline")) -> DataFrame:
    """(algorithm, level, metric, value) for several taxonomies side by side. With
    ``groups`` of related entities, also their pairs' depth (mean over all groups'
    pairs, a metric of the whole taxonomy: level 0)."""
    out = None
    for name, tax in taxonomies.items():
        parts = [tax_topic_counts(tax).select("level", F.lit("counts").alias("metric"),
                                               F.col("n_topics").cast("double").alias("value")),
                 tax_split_fraction(tax).select("level", F.lit("split_fraction").alias("metric"),
                                                F.col("split_fraction").alias("value")),
                 tax_kl_uniform(tax).select("level", F.lit("kl").alias("metric"), F.col("kl").alias("value")),
                 tax_chisq(tax).select("level", F.lit("chisq").alias("metric"), F.col("chisq").alias("value"))]
        if groups is not None:
            depth = pairwise_depth(tax, groups, keys).agg(F.sum(F.col("depth") * F.col("n_pairs")) / F.sum("n_pairs")).toDF("value")
            parts.append(depth.select(F.lit(0).alias("level"), F.lit("depth").alias("metric"), "value"))
        for p in parts:
            p = p.withColumn("algorithm", F.lit(name))
            out = p if out is None else out.unionByName(p)
    return out


def level_drilldown_counts(taxonomy: DataFrame, fixed: dict[int, str]) -> DataFrame:
    """Entities per child topic once Level_1..Level_i are fixed."""
    d = taxonomy
    for lv, val in fixed.items():
        d = d.where(F.col(f"Level_{lv}") == val)
    child = f"Level_{max(fixed) + 1}"
    return d.groupBy(F.col(child).alias("topic")).agg(F.count("*").alias("n_entities"))


def confidence_sweep(labelled: DataFrame, thresholds: Sequence[int] = (60, 70, 80, 90)) -> DataFrame:
    """Per threshold: share of entities at or below it (removed) and share
    labelled good among those at or above it."""
    t = labelled.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold int")
    c, good = F.col("confidence"), (F.col("label") == "good").cast("int")
    return (labelled.crossJoin(F.broadcast(t))  # literal parameter table
            .groupBy("threshold")
            .agg(F.avg((c <= F.col("threshold")).cast("int")).alias("removed"),
                 (F.sum(F.when(c >= F.col("threshold"), good)) /
                  F.sum(F.when(c >= F.col("threshold"), 1))).alias("good")))


def label_quality(labelled: DataFrame) -> DataFrame:
    """Label counts with mean and median confidence per label."""
    return (labelled.groupBy("label")
            .agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
                 F.percentile("confidence", F.lit(0.5)).alias("median_confidence")))


def classification_scores(labelled: DataFrame, truth: str = "truth", pred: str = "predicted") -> DataFrame:
    """Confusion counts and accuracy / precision / recall / F1 for a 0/1 label."""
    t, p = F.col(truth), F.col(pred)
    agg = labelled.agg(F.sum(((t == 1) & (p == 1)).cast("int")).alias("tp"),
                       F.sum(((t == 0) & (p == 1)).cast("int")).alias("fp"),
                       F.sum(((t == 1) & (p == 0)).cast("int")).alias("fn"),
                       F.sum(((t == 0) & (p == 0)).cast("int")).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = tp / (tp + fp), tp / (tp + fn)
    return (agg.withColumn("accuracy", (tp + tn) / (tp + fp + fn + tn))
            .withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", F.lit(2) * prec * rec / (prec + rec)))
