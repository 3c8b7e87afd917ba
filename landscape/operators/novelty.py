"""Topic-pair novelty (survey 2.D), after Uzzi et al.: a pair of topics is
common in year t when it co-occurs more often than its topics' pair
activity predicts; a document is novel when its 10th-percentile pair
commonness is low.

Plan shape. Topics are deduplicated per document with a partial-aggregated
``collect_set`` (a document holds at most as many distinct topics as its
taxonomy level has, so the set is bounded by the taxonomy, not the data).
Documents of the same year and topics are one class; pairs are generated
inside each class's row with higher-order functions, and pair counts are
partial-aggregated before their shuffle. Per-topic pair activity ``N_i(t)`` and the yearly
total ``N_t`` are computed algebraically from the per-document topic counts
(a topic in a document with n topics is in n - 1 of its pairs), with no
second pass over the pairs. The pair-commonness table is bounded by
(topics at the level)^2 x years. What is joined to classes and documents is staged
and counted before: it is sent to all tasks if it has few rows, and merged otherwise
(``_joined``), as the planner's estimate of rows made of a compact file is far too small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.quantiles import percentile as exact_percentile, with_quantiles
from ..session import scratch_path

SENT_ROWS = 100_000  # rows that are sent to all tasks at most


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written once and read back, and its number of rows."""
    path, seen = scratch_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get.get("rows") or 0


def _joined(df: DataFrame, side: DataFrame, rows: int, on: Sequence[str]) -> DataFrame:
    """``df`` joined to a ``side`` of ``rows`` rows; ``df`` never passes the driver."""
    return df.join(F.broadcast(side), on) if rows <= SENT_ROWS else df.hint("merge").join(side, on)


def novelty_input(doc_topics: DataFrame, docs: DataFrame, level: int | Sequence[int] = 3,
                  source: str = "openalex", id_column: str = "work_id") -> DataFrame:
    """(id, year, n_topics, topics) for documents with two or more distinct topics.

    ``topics`` is the sorted array of distinct topics. Documents without a
    year are dropped. Given several levels, ``level`` becomes a key column
    and every downstream operator is called with ``by=["level"]``: all levels
    are computed in one pass instead of one job per level.
    """
    many = not isinstance(level, int)
    lv = F.col("level").isin(list(level)) if many else (F.col("level") == level)
    keys = ["level", "doc_id"] if many else ["doc_id"]
    per_doc = (doc_topics.where(lv & (F.col("source") == source))
               .groupBy(*keys).agg(F.array_sort(F.collect_set("topic")).alias("topics"))
               .withColumn("n_topics", F.size("topics"))
               .where(F.col("n_topics") >= 2))
    years = docs.where(F.col("source") == source).select("doc_id", "year").dropDuplicates(["doc_id"])
    return (per_doc.join(years, "doc_id", "left")
            .where(F.col("year").isNotNull())
            .select(*(["level"] if many else []), F.col("doc_id").alias(id_column),
                    F.col("year").cast("int").alias("year"),
                    F.col("n_topics").cast("int").alias("n_topics"), "topics"))


def _pairs_of(topics: Column) -> Column:
    """All (topic_1 < topic_2) of a sorted, distinct array, as an array of structs."""
    return F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(topics) - 1),
        lambda i: F.transform(F.slice(topics, i + 1, F.size(topics) - i),
                              lambda y: F.struct(F.element_at(topics, i).alias("topic_1"),
                                                 y.alias("topic_2")))))


def document_topic_pairs(novelty_in: DataFrame, id_column: str = "work_id", by: Sequence[str] = ()) -> DataFrame:
    return (novelty_in.select(*by, id_column, "year", F.inline(_pairs_of(F.col("topics"))))
            .withColumn("topic_pair", F.concat_ws("_x_", "topic_1", "topic_2")))


def topic_pair_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N_ij(t): documents containing the pair, per year."""
    return (pairs.groupBy(*by, "topic_1", "topic_2", "year").agg(F.count("*").alias("counts"))
            .withColumn("topic_pair", F.concat_ws("_x_", "topic_1", "topic_2")))


def topic_pair_membership(novelty_in: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N_i(t): sum of the pair counts of all pairs containing topic i in year t."""
    return (novelty_in.select(*by, "year", (F.col("n_topics") - 1).alias("_k"), F.explode("topics").alias("topic"))
            .groupBy(*by, "topic", "year").agg(F.sum("_k").alias("counts")))


def yearly_pair_totals(novelty_in: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N_t: all pair counts of the year = sum over documents of n(n-1)/2."""
    n = F.col("n_topics").cast("bigint")
    return novelty_in.groupBy(*by, "year").agg(F.sum(n * (n - 1) / 2).cast("bigint").alias("N_t"))


def _classes(novelty_in: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, year, topics, _n): documents of the same year and topics are one class, as
    all that novelty knows of a document is these; ``_n`` is their number."""
    return novelty_in.groupBy(*by, "year", "topics").agg(F.count("*").alias("_n"))


def topic_pair_commonness(novelty_in: DataFrame, id_column: str = "work_id", by: Sequence[str] = (),
                          classes: DataFrame | None = None) -> DataFrame:
    """One row per (pair, year): N_ij_t * N_t / (N_i_t * N_j_t)."""
    by = list(by)
    classes = _classes(novelty_in, by) if classes is None else classes
    pairs = classes.select(*by, "year", "_n", F.inline(_pairs_of(F.col("topics"))))
    counts = (pairs.groupBy(*by, "topic_1", "topic_2", "year").agg(F.sum("_n").alias("N_ij_t"))
              .withColumn("topic_pair", F.concat_ws("_x_", "topic_1", "topic_2")))
    member = topic_pair_membership(novelty_in, by)
    n_i = member.select(*by, F.col("topic").alias("topic_1"), "year", F.col("counts").alias("N_i_t"))
    n_j = member.select(*by, F.col("topic").alias("topic_2"), "year", F.col("counts").alias("N_j_t"))
    return (counts
            .join(n_i, by + ["topic_1", "year"])
            .join(n_j, by + ["topic_2", "year"])
            .join(yearly_pair_totals(novelty_in, by), by + ["year"])
            .withColumn("commonness",
                        F.col("N_ij_t") * F.col("N_t") / (F.col("N_i_t") * F.col("N_j_t")))
            .select(*by, "topic_1", "topic_2", "topic_pair", "year", "N_ij_t", "N_i_t", "N_j_t", "N_t",
                    "commonness"))


def document_novelty(novelty_in: DataFrame, id_column: str = "work_id",
                     percentile: float = 10.0, commonness: DataFrame | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Per document: the given linear percentile of its pairs' commonness and
    novelty = -ln(commonness), with n_topics and topics. Computed once for each class
    of documents of the same year and topics, and joined to the documents: pairs are
    made of classes, so no row is moved for a document's pair."""
    by = list(by)
    # read for the counts, for the percentiles and for the scores; numbers are written, so a class keeps its own
    classes, some = _staged(_classes(novelty_in, by).withColumn("_id", F.monotonically_increasing_id()), "novelty-classes")
    if commonness is None:
        commonness = topic_pair_commonness(novelty_in, id_column, by, classes)
    keys = by + ["topic_1", "topic_2", "year"]
    common, rows = _staged(commonness.select(*keys, "commonness"), "novelty-commonness")
    pairs = classes.select(*by, "year", "_id", F.inline(_pairs_of(F.col("topics"))))
    scores = (_joined(pairs, common, rows, keys).groupBy("_id")
              .agg(exact_percentile("commonness", percentile / 100.0).alias("commonness"))
              .withColumn("novelty", -F.log(F.col("commonness"))))
    scores, _ = _staged(classes.select(*by, "year", "topics", "_id").hint("merge").join(scores, "_id").drop("_id"), "novelty-scores")
    docs = novelty_in.where(F.col(id_column).isNotNull()).select(*by, id_column, "year", "n_topics", "topics")
    return (_joined(docs, scores, some, by + ["year", "topics"])
            .select(*by, id_column, "year", "commonness", "novelty", "n_topics", "topics"))


def topic_document_novelty(doc_novelty: DataFrame, id_column: str = "work_id",
                           aggregation: str = "median") -> DataFrame:
    """Per (topic, year): aggregated novelty of the documents carrying it."""
    docs = doc_novelty.select(id_column, "year", "novelty", F.explode("topics").alias("topic"))
    name, counted = "topic_doc_novelty", F.count(id_column).alias("doc_counts")
    if aggregation == "median":
        base = docs.groupBy("topic", "year").agg(counted)
        return with_quantiles(base, docs, ["topic", "year"], "novelty", {name: 0.5}).select("topic", "year", name, "doc_counts")
    agg = {"mean": F.avg("novelty"), "max": F.max("novelty"), "min": F.min("novelty")}[aggregation]
    return docs.groupBy("topic", "year").agg(agg.alias(name), counted)


def topic_pair_novelty(commonness: DataFrame, min_counts: int = 0,
                       percentile: float = 10.0) -> DataFrame:
    """Per (topic, year) over pairs seen more than ``min_counts`` times."""
    ends = F.array(F.col("topic_1"), F.col("topic_2"))
    return (commonness.where(F.col("N_ij_t") > min_counts)
            .select(F.explode(ends).alias("topic"), "year", "commonness", "N_ij_t")
            .groupBy("topic", "year")
            .agg(exact_percentile("commonness", percentile / 100.0).alias("topic_pair_commonness"),
                 F.sum("N_ij_t").alias("pair_counts"))
            .withColumn("topic_pair_novelty", -F.log("topic_pair_commonness")))


def topic_novelty(doc_novelty: DataFrame, commonness: DataFrame, topic_names: DataFrame,
                  level: int = 3, min_pair_counts: int = 50, min_doc_counts: int = 50,
                  id_column: str = "work_id") -> DataFrame:
    """Document- and pair-based topic novelty side by side, with names."""
    names = topic_names.where(F.col("level") == level).select("topic", F.col("name").alias("topic_name"))
    return (topic_document_novelty(doc_novelty, id_column)
            .join(topic_pair_novelty(commonness, min_pair_counts), ["topic", "year"], "left")
            .where(F.col("doc_counts") > min_doc_counts)
            .join(names, "topic", "left"))


def topic_to_documents(doc_novelty: DataFrame, docs: DataFrame, id_column: str = "work_id") -> DataFrame:
    """Long (topic, id, title, novelty, year, n_topics); group on read."""
    titles = docs.select(F.col("doc_id").alias(id_column), F.col("title").alias("display_name"))
    return (doc_novelty.select(F.explode("topics").alias("topic"), id_column, "novelty", "year", "n_topics")
            .join(titles, id_column, "left"))


def top_novel_topics(topic_nov: DataFrame, year: int, most_novel: bool = True, top_n: int = 10,
                     measure: str = "topic_doc_novelty") -> DataFrame:
    m = F.col(measure)
    order = [m.desc(), F.col("topic")] if most_novel else [m.asc(), F.col("topic")]
    top = topic_nov.where((F.col("year") == year) & m.isNotNull()).orderBy(*order).limit(top_n)
    return top


def top_novel_documents(doc_novelty: DataFrame, docs: DataFrame, year: int, topic: str | None = None,
                        most_novel: bool = True, top_n: int = 10, min_topics: int = 2,
                        id_column: str = "work_id") -> DataFrame:
    d = doc_novelty.where((F.col("year") == year) & (F.col("n_topics") >= min_topics))
    if topic is not None:
        d = d.where(F.array_contains("topics", topic))
    order = [F.col("novelty").desc()] if most_novel else [F.col("novelty").asc()]
    titles = docs.select(F.col("doc_id").alias(id_column), F.col("title").alias("display_name"))
    return (d.orderBy(*order, F.col(id_column)).limit(top_n)
            .join(titles, id_column, "left"))


def documents_with_text(docs: DataFrame, doc_novelty: DataFrame, pattern: str, min_n_topics: int = 5,
                        id_column: str = "work_id") -> DataFrame:
    """Documents whose lower-cased title matches ``pattern``, with their novelty."""
    nov = doc_novelty.dropDuplicates([id_column]).select(id_column, "novelty", "n_topics")
    return (docs.select(F.col("doc_id").alias(id_column), F.col("title").alias("display_name"))
            .where(F.lower("display_name").rlike(pattern))
            .join(nov, id_column, "left")
            .where(F.col("novelty").isNotNull() & (F.col("n_topics") >= min_n_topics)))


def combine_novelty_sources(works_topic_novelty: DataFrame, patents_topic_novelty: DataFrame) -> DataFrame:
    return (works_topic_novelty.withColumn("source", F.lit("Research publications"))
            .unionByName(patents_topic_novelty.withColumn("source", F.lit("Patents"))))


def novelty_growth(topic_nov: DataFrame, start_year: int, end_year: int,
                   measure: str = "topic_doc_novelty") -> DataFrame:
    """Per topic: mean novelty over [start, end], smoothed growth between the
    two years before start and the two years before end, and summed counts."""
    y, m = F.col("year"), F.col(measure)

    def mean_in(lo: int, hi: int) -> Column:
        return F.avg(F.when(y.between(lo, hi), m))

    base = mean_in(start_year - 2, start_year - 1)
    last = mean_in(end_year - 2, end_year - 1)
    return (topic_nov.groupBy("topic")
            .agg(mean_in(start_year, end_year).alias("avg_novelty"),
                 ((last - base) / base).alias("growth"),
                 F.sum(F.when(y.between(start_year, end_year), F.col("doc_counts"))).alias("doc_counts")))


def novelty_quadrant(growth: DataFrame) -> DataFrame:
    """Topics with growing novelty are "emerging" (average novelty below the
    median over all topics) or "hot" (at or above it); declining ones are
    "stable common" (below) or "stable uncommon" (at or above). ``abs_growth``
    is the size of the growth or decline."""
    med = growth.agg(F.percentile("avg_novelty", F.lit(0.5)).alias("_med"))
    g, a = F.col("growth"), F.col("avg_novelty")
    high = a >= F.col("_med")
    label = (F.when((g > 0) & ~high, "emerging")
             .when(g > 0, "hot")
             .when(high, "stable uncommon")
             .otherwise("stable common"))
    return (growth.where(g != 0).crossJoin(med)  # one-row side
            .withColumn("abs_growth", F.abs(g)).withColumn("quadrant", label).drop("_med"))


def novelty_zscore_wide(combined: DataFrame, year: int, measure: str = "topic_doc_novelty") -> DataFrame:
    """Topic x source for one year, each source's column also as a z-score
    over topics (sample standard deviation)."""
    wide = (combined.where(F.col("year") == year)
            .groupBy("topic").pivot("source", ["Research publications", "Patents"]).agg(F.first(measure))
            .withColumnRenamed("Research publications", "OpenAlex"))
    stats = wide.agg(F.avg("OpenAlex").alias("_mo"), F.stddev_samp("OpenAlex").alias("_so"),
                     F.avg("Patents").alias("_mp"), F.stddev_samp("Patents").alias("_sp"))
    return (wide.crossJoin(stats)  # one-row side
            .withColumn("openalex_zscore", (F.col("OpenAlex") - F.col("_mo")) / F.col("_so"))
            .withColumn("patents_zscore", (F.col("Patents") - F.col("_mp")) / F.col("_sp"))
            .drop("_mo", "_so", "_mp", "_sp"))


def top_growth_topics(growth: DataFrame, top_n: int = 25, rising: bool = True) -> DataFrame:
    order = F.col("growth").desc() if rising else F.col("growth").asc()
    return growth.where(F.col("growth").isNotNull()).orderBy(order, "topic").limit(top_n)


def novelty_vs_popularity(topic_nov: DataFrame, year: int, min_docs: int = 50) -> DataFrame:
    return topic_nov.where((F.col("year") == year) & (F.col("doc_counts") >= min_docs))


def novelty_timeseries(topic_nov: DataFrame, topics: DataFrame) -> DataFrame:
    return topic_nov.join(topics.select("topic"), "topic", "left_semi")
