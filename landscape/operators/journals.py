"""Journal x topic statistics (survey 2.L).

Base table ``(entity, journal, Level_1..Level_k, count)``: journal mention
counts of every entity, with the entity's taxonomy path. Everything stays
long (journal, topic, value); nothing is pivoted to a journal x topic matrix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import unit_hash


def entity_journal_levels(journal_entity_counts: DataFrame, taxonomy: DataFrame, levels: int = 3) -> DataFrame:
    tax = taxonomy.select("entity", *[f"Level_{i}" for i in range(1, levels + 1)])
    return journal_entity_counts.select("entity", "journal", "count").join(tax, "entity")


def inside(ejl: DataFrame, level: int, parent: str | None) -> DataFrame:
    """Rows under a parent topic of the level above; all rows without one."""
    return ejl if parent is None else ejl.where(F.col(f"Level_{level - 1}") == parent)


def sample_journals(ejl: DataFrame, n: int, level: int = 1, parent: str | None = None, seed: int = 0) -> DataFrame:
    """n journals drawn by a seeded hash of their name."""
    return (inside(ejl, level, parent).select("journal").distinct()
            .orderBy(unit_hash("journal", seed), "journal").limit(n))


def main_journals(ejl: DataFrame, n: int = 50, level: int = 1, parent: str | None = None) -> DataFrame:
    """Top-n journals by number of entity rows (inside a parent topic for
    level > 1), "Other" removed; ties by name."""
    d = inside(ejl, level, parent)
    return (d.groupBy("journal").agg(F.count("*").alias("rows"))
            .orderBy(F.col("rows").desc(), "journal").limit(n)
            .where(F.col("journal") != "Other"))


def journal_topic_counts(ejl: DataFrame, level: int) -> DataFrame:
    return ejl.groupBy("journal", F.col(f"Level_{level}").alias("topic")).agg(F.sum("count").alias("size"))


def relevant_topics(ejl: DataFrame, level: int, threshold: float = 0.8, method: str = "relative") -> DataFrame:
    """Per journal: topics in descending size, kept while the cumulative size
    *before* the topic is within threshold x total (ties by topic)."""
    c = journal_topic_counts(ejl, level)
    order = Window.partitionBy("journal").orderBy(F.col("size").desc(), "topic")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("size").over(Window.partitionBy("journal"))
    out = c.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("total", total)
    value = F.col("size") / F.col("total") if method == "relative" else F.col("size")
    return (out.where(F.col("_before") <= F.lit(threshold) * F.col("total"))
            .withColumn("value", value).drop("_before"))


def journal_topic_unary(ejl: DataFrame, level: int = 1, threshold: float = 0.8, n: int = 50,
                        parent: str | None = None) -> DataFrame:
    """Relevant topics of the main journals (all inside a parent topic for level
    > 1) with the journal's topic diversity (number of relevant topics) and the
    topic's id number."""
    d = inside(ejl, level, parent)
    mj = main_journals(d, n).select("journal")
    r = relevant_topics(d, level, threshold).join(mj, "journal", "left_semi")
    return (r.withColumn("diversity", F.count("*").over(Window.partitionBy("journal")))
            .withColumn("topic_number", F.element_at(F.split("topic", "_"), -1).cast("int")))


def journal_topic_frequency(ejl: DataFrame, level: int = 1, n: int = 50, parent: str | None = None) -> DataFrame:
    d = inside(ejl, level, parent)
    mj = main_journals(d, n).select("journal")
    c = journal_topic_counts(d, level).join(mj, "journal", "left_semi")
    return c.withColumn("frequency", F.col("size") / F.sum("size").over(Window.partitionBy("journal")))


def journal_topic_tfidf(ejl: DataFrame, level: int = 1, n: int = 50, parent: str | None = None) -> DataFrame:
    """tf = topic count / journal total; idf = ln(J / journals with the topic)
    over all journals; main journals only, tf-idf > 0."""
    ejl = inside(ejl, level, parent)
    c = journal_topic_counts(ejl, level)
    n_j = c.agg(F.countDistinct("journal").alias("_J"))
    df_t = c.groupBy("topic").agg(F.countDistinct("journal").alias("_df"))
    tf = c.withColumn("tf", F.col("size") / F.sum("size").over(Window.partitionBy("journal")))
    mj = main_journals(ejl, n).select("journal")
    return (tf.join(mj, "journal", "left_semi").join(df_t, "topic").crossJoin(n_j)  # one-row side
            .withColumn("idf", F.log(F.col("_J") / F.col("_df")))
            .withColumn("tfidf", F.col("tf") * F.col("idf"))
            .where(F.col("tfidf") > 0).drop("_J", "_df"))


def journal_dominance(values: DataFrame, value: str = "size") -> DataFrame:
    return values.groupBy("journal").agg((F.lit(100.0) * F.max(value) / F.sum(value)).alias("dominance"))


def parent_topic_totals(ejl: DataFrame, level: int) -> DataFrame:
    """Sum of counts inside each parent topic (the level above)."""
    return ejl.groupBy(F.col(f"Level_{level - 1}").alias("parent")).agg(F.sum("count").alias("total"))


def topic_id_number(ejl: DataFrame, level: int) -> DataFrame:
    return (ejl.select(F.col(f"Level_{level}").alias("topic")).distinct()
            .withColumn("number", F.element_at(F.split("topic", "_"), -1).cast("int"))
            .orderBy("number", "topic"))


def topic_density(named: DataFrame, level: int, n_top: int = 20) -> DataFrame:
    """Normalised frequency of the named clusters of a level, top n."""
    name = f"Level_{level}_Entity_Names"
    c = named.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    tot = c.agg(F.sum("n").alias("_t"))
    return (c.crossJoin(tot)  # one-row side
            .withColumn("density", F.col("n") / F.col("_t")).drop("_t")
            .orderBy(F.col("n").desc(), "name").limit(n_top))
