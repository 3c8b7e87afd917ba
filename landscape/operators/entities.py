"""Entity selection and topic tagging (survey 2.C).

Input is the long mention table ``(doc_id, source, pos, entity, confidence)``;
outputs stay long. Nothing is collected per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import unit_hash

LEVELS = (1, 2, 3, 4, 5)


def entities_kept(doc_entities: DataFrame, threshold: int = 80) -> DataFrame:
    return doc_entities.where(F.col("confidence") >= threshold)


def entities_discarded(doc_entities: DataFrame, threshold: int = 80) -> DataFrame:
    return doc_entities.where(F.col("confidence") < threshold)


def entity_frequencies(mentions: DataFrame) -> DataFrame:
    """Mentions per entity; repeated mentions count."""
    return mentions.groupBy("entity").agg(F.count("*").alias("frequency"))


def filter_entities_absolute(mentions: DataFrame, min_freq: int = 0, max_freq: int = 100) -> DataFrame:
    """Mentions of entities whose global frequency lies in [min_freq, max_freq]."""
    if min_freq >= max_freq:
        raise ValueError("min_freq must be less than max_freq")
    keep = entity_frequencies(mentions).where(F.col("frequency").between(min_freq, max_freq))
    return mentions.join(keep.select("entity"), "entity", "left_semi")


def filter_entities_percentile(mentions: DataFrame, min_pct: float = 0, max_pct: float = 100) -> DataFrame:
    """As above, bounds are linear percentiles of the frequency distribution."""
    if min_pct >= max_pct:
        raise ValueError("min_pct must be less than max_pct")
    freq = entity_frequencies(mentions)
    bounds = freq.agg(F.percentile("frequency", F.lit(min_pct / 100.0)).alias("_lo"),
                      F.percentile("frequency", F.lit(max_pct / 100.0)).alias("_hi"))
    keep = (freq.crossJoin(bounds)  # one-row side
            .where((F.col("frequency") >= F.col("_lo")) & (F.col("frequency") <= F.col("_hi"))))
    return mentions.join(keep.select("entity"), "entity", "left_semi")


def sample_documents(mentions: DataFrame, num_articles: int = -1, seed: int = 0) -> DataFrame:
    """Keep whole documents with probability num_articles / N (all when -1).

    The draw is a seeded hash of the document id, so it is the same however
    the data is partitioned.
    """
    if num_articles == -1:
        return mentions
    n_docs = mentions.agg(F.countDistinct("doc_id").alias("_n"))
    return (mentions.crossJoin(n_docs)  # one-row side
            .where(unit_hash("doc_id", seed) < F.lit(float(num_articles)) / F.col("_n"))
            .drop("_n"))


def distinct_entities(mentions: DataFrame) -> DataFrame:
    return mentions.select("entity").distinct()


def entity_document_index(doc_entities: DataFrame, threshold: int = 80, min_freq: int = 10) -> DataFrame:
    """(entity, document) for kept entities mentioned at least ``min_freq`` times.

    Document ids lose any URL prefix. Sorting by entity lets a reader seek.
    """
    kept = entities_kept(doc_entities, threshold)
    freq = entity_frequencies(kept).where(F.col("frequency") >= min_freq)
    return (kept.join(freq.select("entity"), "entity", "left_semi")
            .select("entity", F.regexp_replace("doc_id", r"^https?://[^/]+/", "").alias("document"))
            .distinct())


def tag_mentions(doc_entities: DataFrame, taxonomy: DataFrame, threshold: int = 80) -> DataFrame:
    """One row per mention with its topics of all five levels as columns.

    Mentions below the threshold or of entities outside the taxonomy carry no topic.
    """
    return (entities_kept(doc_entities, threshold).select("doc_id", "source", "entity")
            .join(taxonomy, "entity").select("doc_id", "source", *[f"Level_{i}" for i in LEVELS]))


def long_tags(tags: DataFrame) -> DataFrame:
    """``tag_mentions`` as doc -> topic rows: a selection per level, so that a reader
    of one level reads one column of a stored table, and the others not at all."""
    out = None
    for i in LEVELS:
        one = tags.select("doc_id", "source", F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic"))
        out = one if out is None else out.unionByName(one)
    return out


def tag_documents(doc_entities: DataFrame, taxonomy: DataFrame, threshold: int = 80) -> DataFrame:
    """Long doc -> topic tags for all five levels in one pass; duplicate tags (two
    entities, same topic) are kept."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic"))
                       for i in LEVELS])
    return tag_mentions(doc_entities, taxonomy, threshold).select("doc_id", "source", F.inline(levels))


def article_assignments(doc_entities: DataFrame, taxonomy: DataFrame, level: int = 1) -> DataFrame:
    """doc -> {entity: topic} at one level, every confidence."""
    return (doc_entities.select("doc_id", "entity")
            .join(taxonomy.select("entity", F.col(f"Level_{level}").alias("topic")), "entity")
            .select("doc_id", "entity", "topic").distinct())


def article_topic_counts(assignments: DataFrame) -> DataFrame:
    """doc -> {topic: number of distinct entities}."""
    return assignments.groupBy("doc_id", "topic").agg(F.count("*").alias("n_entities"))
