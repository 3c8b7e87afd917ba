"""Queries behind the dashboard pages (survey 2.F).

They run over the indicator tables of 2.E, which are small relative to the
raw data (one row per topic-year or per organisation-topic-year), plus the
long document tables for the drill-downs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import mean6
from ..functions.quantiles import with_quantiles


def alignment_long(volume: DataFrame) -> DataFrame:
    ids = [c for c in volume.columns if c not in ("publication_count", "patent_count", "total_docs")]
    return volume.unpivot(ids, ["publication_count", "patent_count"], "doc_type", "count")


def filter_by(df: DataFrame, level: str, value: str) -> DataFrame:
    """Rows whose ``{level}_name`` equals the selection."""
    return df.where(F.col(f"{level}_name") == value)


def next_level_options(df: DataFrame, level: str) -> DataFrame:
    """Sorted (case-insensitive) distinct names of the next level, for the selector."""
    return (df.select(F.col(f"{level}_name").alias("option")).where(F.col("option").isNotNull())
            .distinct().orderBy(F.lower("option"), "option"))


def emergence_by_level(volume: DataFrame, level: str, y_col: str) -> DataFrame:
    return (volume.where(F.col("year").isNotNull())
            .groupBy(level, f"{level}_name", "year").agg(F.sum(y_col).alias(y_col)))


def alignment_by_level(alignment: DataFrame, level: str) -> DataFrame:
    """Per (doc_type, level id): total and share of that document type's total
    within the current selection."""
    g = alignment.groupBy("doc_type", level, f"{level}_name").agg(F.sum("count").alias("total"))
    totals = alignment.groupBy("doc_type").agg(F.sum("count").alias("_all"))  # two rows
    return (g.join(F.broadcast(totals), "doc_type")
            .withColumn("doc_fraction", F.col("total") / F.col("_all"))
            .withColumn("doc_name_clean", F.when(F.col("doc_type") == "publication_count", "Publications")
                        .when(F.col("doc_type") == "patent_count", "Patents"))
            .withColumn("doc_percentage", F.col("doc_fraction") * 100)
            .drop("_all"))


def level_view(table: DataFrame, level: str, years: tuple[int, int], measures: Sequence[str]) -> DataFrame:
    """Distinct (level id, year) rows of a trends table with ``{level}_*``
    columns renamed to their suffix, inside an inclusive year range."""
    cols = [F.col(f"{level}_{m}").alias(m) for m in measures]
    return (table.where(F.col("year").between(*years))
            .dropDuplicates([level, "year"])
            .select(level, "year", F.col(f"{level}_name").alias("name"), *cols))


def level_docs(docs: DataFrame, view: DataFrame, level: str, years: tuple[int, int], score: str) -> DataFrame:
    """Distinct (level id, work) documents in the year range with the level name."""
    names = view.select(level, "name").distinct()
    return (docs.where(F.col("year").between(*years)).dropDuplicates([level, "work_id"])
            .join(names, level, "left")
            .select(F.col("work_id").alias("document_link"), F.col("year").alias("document_year"),
                    level, "name", score))


def weighted_by_level(view: DataFrame, level: str, years: tuple[int, int], score: str) -> DataFrame:
    """Over a year range: summed doc counts and the doc-weighted mean score."""
    v = view.where(F.col("year").between(*years))
    names = view.select(level, "name").distinct()
    return (v.groupBy(level)
            .agg(F.sum("doc_counts").alias("doc_counts"),
                 # exact and order-independent (scores taken to 6 decimals)
                 mean6(score, "doc_counts", scale=6).alias(score))
            .join(names, level, "left"))


def sorted_docs(docs: DataFrame, years: tuple[int, int], score: str) -> DataFrame:
    """The documents of a year range, highest score first."""
    return docs.where(F.col("document_year").between(*years)).orderBy(F.col(score).desc(), "document_link")


def extremes(docs: DataFrame, score: str, n: int = 50, key: str = "document_link") -> DataFrame:
    """The n highest and the n lowest documents, with their side and rank; ties by key."""
    def side(name: str, order: list) -> DataFrame:
        top = docs.orderBy(*order).limit(n)  # n rows from here on
        return top.withColumn("side", F.lit(name)).withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(*order)))
    return side("most", [F.col(score).desc(), F.col(key)]).unionByName(side("least", [F.col(score), F.col(key)]))


def yearly_rank(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(Window.partitionBy("year").orderBy(score)))


def disruption_interval(docs: DataFrame, key: str = "name") -> DataFrame:
    base = docs.groupBy(key, "year").agg(mean6("cd_score", scale=3).alias("mean"))
    return with_quantiles(base, docs, [key, "year"], "cd_score", {"p10": 0.1, "p90": 0.9})


def disruption_histogram(docs: DataFrame, bins: int = 10, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("cd_score") - lo) / width), F.lit(bins - 1)).cast("int")
    return (docs.where(F.col("cd_score").between(lo, hi)).select(b.alias("bin"))
            .groupBy("bin").agg(F.count("*").alias("count"))
            .withColumn("bin_start", F.round(F.lit(lo) + F.col("bin") * width, 6))
            .withColumn("bin_end", F.round(F.lit(lo) + (F.col("bin") + 1) * width, 6)))


def highly_cited_scatter(docs: DataFrame, min_citations: int = 50) -> DataFrame:
    return docs.where(F.col("cited_by_count") > min_citations)


def histogram_bin_examples(docs: DataFrame, titles: DataFrame, lo: float, hi: float, n: int = 5) -> DataFrame:
    """Up to n titles of documents whose score lies in [lo, hi], smallest ids first."""
    d = docs.where(F.col("cd_score").between(lo, hi)).select("work_id").distinct()
    w = Window.orderBy("work_id")
    return (d.orderBy("work_id").limit(n)
            .join(titles, "work_id", "left").withColumn("rank", F.row_number().over(w)))


def search_documents(entity_index: DataFrame, titles: DataFrame, scores: DataFrame,
                     entities: Sequence[str], mode: str = "all", top_n: int = 10,
                     score: str = "novelty") -> DataFrame:
    """Documents containing all (or any) of the entities, best scores first.
    Unknown entities are ignored."""
    q = entity_index.where(F.col("entity").isin(list(entities)))
    known = q.select("entity").distinct().agg(F.count("*").alias("_k"))
    per_doc = q.groupBy("document").agg(F.countDistinct("entity").alias("_m"))
    if mode == "all":
        per_doc = per_doc.crossJoin(known).where(F.col("_m") == F.col("_k"))  # one-row side
    hits = per_doc.select(F.col("document").alias("work_id"))
    return (hits.join(scores.select("work_id", score), "work_id")
            .join(titles, "work_id", "left")
            .orderBy(F.col(score).desc(), "work_id").limit(top_n))


def ranked_novelty_articles(level_docs_df: DataFrame, titles: DataFrame, topic: str = "All") -> DataFrame:
    """Per (document, year, novelty): its topic names; only documents carrying
    ``topic`` unless "All"."""
    g = (level_docs_df.groupBy("document_link", "document_year", "novelty")
         .agg(F.array_sort(F.collect_set("name")).alias("names")))
    if topic != "All":
        g = g.where(F.array_contains("names", topic))
    return (g.join(titles.withColumnRenamed("work_id", "document_link"), "document_link", "left")
            .select("document_link", "document_year", "display_name", "novelty", "names"))


def unique_words(df: DataFrame, col: str) -> DataFrame:
    return (df.select(F.explode(F.split(F.col(col), " ")).alias("word"))
            .where(F.col("word").isNotNull()).distinct())


def quad_by_org(quad: DataFrame, score: str) -> DataFrame:
    return (quad.na.drop(subset=["affiliation_string", "volume", score])
            .groupBy("affiliation_string")
            .agg(F.sum("volume").alias("volume"), F.avg(score).alias(score)))


def network_by_topic(org_rows: DataFrame, nodes: DataFrame, edges_by: DataFrame | None, by: str,
                     value: str) -> tuple[DataFrame, DataFrame | None]:
    """Subgraph of organisations active in one domain/area/topic: node size
    ln(documents), edge weight = documents shared in that selection (of the
    edges of that value, or of all; none where only nodes are wanted)."""
    active = org_rows.where(F.col(by) == value).select("org").distinct()
    n = (nodes.join(active, "org", "left_semi")
         .withColumn("size", F.log("n_docs")))
    if edges_by is None:
        return n, None
    e = (edges_by.where(F.col(by) == value)
         .join(active.withColumnRenamed("org", "org_1"), "org_1", "left_semi")
         .join(active.withColumnRenamed("org", "org_2"), "org_2", "left_semi")
         .select("org_1", "org_2", F.col("n_docs").alias("weight")))
    return n, e
