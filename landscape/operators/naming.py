"""Topic naming from entity and journal statistics (survey 2.G).

Everything is long: (journal, entity) mentions, (topic, entity, count),
(topic, journal, rank). Top-n lists are built with ``row_number`` inside a
topic and joined in rank order, so a topic never collects more than n items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import global_row_number


def journal_entities(works: DataFrame, mentions: DataFrame) -> DataFrame:
    """(journal, entity) mention rows of works that have a venue."""
    venues = works.select(F.col("work_id").alias("doc_id"), F.col("venue_display_name").alias("journal")) \
        .where(F.col("journal").isNotNull())
    return mentions.select("doc_id", "entity").join(venues, "doc_id").select("journal", "entity")


def entity_counts(je: DataFrame) -> DataFrame:
    return je.groupBy("entity").agg(F.count("*").alias("count"))


def level_entity_counts(je: DataFrame, taxonomy: DataFrame, level: int = 1) -> DataFrame:
    """(topic, entity, count) for entities of the taxonomy."""
    tax = taxonomy.select("entity", F.col(f"Level_{level}").alias("topic"))
    return entity_counts(je).join(tax, "entity").select("topic", "entity", "count")


def journal_entity_counts(je: DataFrame) -> DataFrame:
    """(journal, entity, count, share of the journal's mentions)."""
    c = je.groupBy("journal", "entity").agg(F.count("*").alias("count"))
    # journal totals as a grouped table (one row per journal) joined back: a
    # window over a hot journal would put all of its entities in one task
    tot = c.groupBy("journal").agg(F.sum("count").alias("_tot"))
    return c.join(tot, "journal").withColumn("share", F.col("count") / F.col("_tot")).drop("_tot")


def cluster_entity_journal_counts(je: DataFrame, taxonomy: DataFrame, level: int = 1) -> DataFrame:
    tax = taxonomy.select("entity", F.col(f"Level_{level}").alias("topic"))
    return journal_entity_counts(je).join(tax, "entity").select("topic", "entity", "journal", "count")


def cluster_journal_counts(je: DataFrame, taxonomy: DataFrame, level: int = 1) -> DataFrame:
    """(topic, journal, count): journal mentions summed over the topic's entities."""
    return (cluster_entity_journal_counts(je, taxonomy, level)
            .groupBy("topic", "journal").agg(F.sum("count").alias("count")))


def _top_joined(df: DataFrame, key: str | list[str], item: str, score: str, n: int, label) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(item))
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return (top.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_rn", label.alias("_s")))).alias("_l"))
            .select(*keys, F.array_join(F.transform("_l", lambda x: x["_s"]), ", ").alias("names")))


def topic_entity_names(lec: DataFrame, num_entities: int = 10, show_count: bool = False) -> DataFrame:
    """(topic, names): the topic's most frequent entities, ties by entity."""
    label = (F.concat(F.col("entity"), F.lit(" ("), F.col("count").cast("string"), F.lit(" times)"))
             if show_count else F.col("entity"))
    return _top_joined(lec, "topic", "entity", "count", num_entities, label)


def cluster_journal_ranks(je: DataFrame, taxonomy: DataFrame, level: int = 1,
                          output: str = "relative") -> DataFrame:
    """(topic, journal, rank) with
    rank = sum over the topic's entities e in journal j of
           ln(2 + c_e / n)^2 * ln(1 + c_tj / n)^2 * share(j, e),
    n = total entity count of the topic (relative) or 1 (absolute)."""
    tax = taxonomy.select("entity", F.col(f"Level_{level}").alias("topic"))
    return _journal_ranks(je, tax, ["topic"], output)


def _journal_ranks(je: DataFrame, topics: DataFrame, key: list[str], output: str) -> DataFrame:
    """Ranks of journals for every topic (``key``) of (entity, key) rows. Counts per
    entity and per (journal, entity) are made once, however many keys there are."""
    shares = journal_entity_counts(je)
    lec = entity_counts(je).join(topics, "entity").select(*key, "entity", "count")
    n = (lec.groupBy(*key).agg(F.sum("count").alias("_n")) if output == "relative"
         else lec.select(*key).distinct().withColumn("_n", F.lit(1)))
    cjc = shares.join(topics, "entity").groupBy(*key, "journal").agg(F.sum("count").alias("_cj"))
    terms = (lec.join(n, key).join(shares.select("journal", "entity", "share"), "entity").join(cjc, [*key, "journal"])
             .withColumn("_t", F.pow(F.log(F.lit(2.0) + F.col("count") / F.col("_n")), 2)
                         * F.pow(F.log(F.lit(1.0) + F.col("_cj") / F.col("_n")), 2) * F.col("share")))
    return terms.groupBy(*key, "journal").agg(F.sum("_t").alias("rank"))


def topic_journal_names(ranks: DataFrame, num_names: int = 3) -> DataFrame:
    top = _top_joined(ranks, "topic", "journal", "rank", num_names, F.col("journal"))
    return top.select("topic", F.concat(F.lit("Journals: "), F.col("names")).alias("names"))


def main_journal(je: DataFrame) -> DataFrame:
    """(entity, journal) with the most mentions; ties by journal name."""
    c = je.groupBy("entity", "journal").agg(F.count("*").alias("count"))
    w = Window.partitionBy("entity").orderBy(F.col("count").desc(), F.col("journal"))
    return (c.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("entity", F.col("journal").alias("main_journal")))


def named_taxonomy(taxonomy: DataFrame, je: DataFrame, levels: int = 3) -> DataFrame:
    """The taxonomy with entity and journal names of its topics, all levels in one
    pass (level is a key), and its entities' counts."""
    key = ["level", "topic"]
    topics = taxonomy.select("entity", F.inline(F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic")) for i in range(1, levels + 1)])))
    lec = entity_counts(je).join(topics, "entity").select(*key, "entity", "count")
    en = _top_joined(lec, key, "entity", "count", 2, F.col("entity")).withColumnRenamed("names", "en")
    jn = _top_joined(_journal_ranks(je, topics, key, "relative"), key, "journal", "rank", 3, F.col("journal"))
    names = en.join(jn.select(*key, F.concat(F.lit("Journals: "), F.col("names")).alias("jn")), key, "full")
    out = taxonomy
    for lvl in range(1, levels + 1):  # names of topics: as many rows as the level has topics
        own = names.where(F.col("level") == lvl).select(F.col("topic").alias(f"Level_{lvl}"), F.col("en").alias(f"Level_{lvl}_Entity_Names"),
                                                        F.col("jn").alias(f"Level_{lvl}_Journal_Names"))
        out = out.join(own, f"Level_{lvl}", "left")
        for c in (f"Level_{lvl}_Entity_Names", f"Level_{lvl}_Journal_Names"):
            out = out.withColumn(c, F.when(F.col(c).isin("", "Journals: "), "Other").otherwise(F.col(c)))
    counts = entity_counts(je)
    n_journals = je.groupBy("entity").agg(F.countDistinct("journal").alias("Journal_Count"))
    return (out.join(main_journal(je), "entity", "left")
            .join(counts, "entity", "left").join(n_journals, "entity", "left")
            .select(*out.columns,
                    F.coalesce("main_journal", F.lit("Other")).alias("Main_Journal"),
                    F.when(F.coalesce("count", F.lit(0)) == 0, 1).otherwise(F.col("count")).alias("Entity_Count"),
                    F.coalesce("Journal_Count", F.lit(0)).alias("Journal_Count")))


def merge_topic_names(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(level, topic, name): stored names win over newly produced ones."""
    both = (stored.select("level", "topic", "name", F.lit(0).alias("_p"))
            .unionByName(new.select("level", "topic", "name", F.lit(1).alias("_p"))))
    w = Window.partitionBy("level", "topic").orderBy("_p")
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_p")


def taxonomy_with_names(taxonomy: DataFrame, names_by_level: dict[int, DataFrame]) -> DataFrame:
    out = taxonomy
    for lvl, names in names_by_level.items():
        out = out.join(names.select(F.col("topic").alias(f"Level_{lvl}"),
                                    F.col("names").alias(f"Level_{lvl}_Entity_Names")), f"Level_{lvl}", "left")
    return out


def pending_topics(taxonomy: DataFrame, names: DataFrame, levels=(1, 2, 3), batch_size: int = 6) -> DataFrame:
    """Topics of the given levels without a name, in batches of ``batch_size``."""
    topics = taxonomy.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic")) for i in levels]))).distinct()
    todo = topics.join(names.select("level", "topic"), ["level", "topic"], "left_anti")
    numbered = global_row_number(todo, ["level", "topic"])
    return numbered.withColumn("batch", F.floor((F.col("rn") - 1) / batch_size).cast("bigint"))


def duplicate_topic_names(names: DataFrame, lec: DataFrame, num_entities: int = 10) -> DataFrame:
    """Topics sharing a name with another topic of the same level, with their entities."""
    w = Window.partitionBy("level", "name")
    dup = names.withColumn("_k", F.count("*").over(w)).where(F.col("_k") > 1).drop("_k")
    ents = topic_entity_names(lec, num_entities)
    return dup.join(ents, "topic", "left").withColumnRenamed("names", "entities")


def top_entities_table(entity_names: DataFrame, names: DataFrame) -> DataFrame:
    return entity_names.join(names, "topic")
