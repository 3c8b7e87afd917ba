"""Indicator tables behind the dashboards (survey 2.E).

Topic ids are path strings ``"d_a_t"``: a level-3 topic carries its area
(first two segments) and domain (first segment). Name and entity tables
are keyed by topic id; they are joined without hints, so the planner
broadcasts them when their measured size allows and sort-merges otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pairs import DEFAULT_CHUNK, pairs_within
from ..functions.quantiles import quartiles
from ..session import scratch_path

PAIRS_A_TASK, ROWS_A_TASK = 500_000, 2_000_000  # of organisations: met in documents, written out by group

LEVEL_COLS = {1: "domain", 2: "area", 3: "topic"}


def expand_topic(df: DataFrame, topic: str = "topic") -> DataFrame:
    return (df.withColumn("domain", F.substring_index(topic, "_", 1))
            .withColumn("area", F.substring_index(topic, "_", 2)))


def names_first_level_wins(topic_names: DataFrame, levels=(1, 2, 3)) -> DataFrame:
    """topic -> name over several levels; the lowest level's name wins."""
    w = Window.partitionBy("topic").orderBy("level")
    return (topic_names.where(F.col("level").isin(list(levels)))
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).select("topic", "name"))


def add_topic_names(df: DataFrame, topic_names: DataFrame) -> DataFrame:
    """Left-join domain, area and topic names (levels 1, 2, 3)."""
    out = df
    for lvl, col in LEVEL_COLS.items():
        names = topic_names.where(F.col("level") == lvl).select(
            F.col("topic").alias(col), F.col("name").alias(f"{col}_name"))
        out = out.join(names, col, "left")
    return out


def docs_with_topics(doc_topics: DataFrame, level: int = 3, source: str | None = None) -> DataFrame:
    """(id, topic) at a level, duplicates kept."""
    d = doc_topics.where(F.col("level") == level)
    if source:
        d = d.where(F.col("source") == source)
    return d.select(F.col("doc_id").alias("id"), "topic")


def count_documents(doc_df: DataFrame) -> DataFrame:
    """Rows per (topic, year); a NULL year is its own group."""
    return doc_df.groupBy("topic", "year").agg(F.count("*").alias("count"))


def volume_table(doc_topics: DataFrame, docs: DataFrame, topic_names: DataFrame) -> DataFrame:
    """Works and patents per (domain, area, topic, year), outer-joined."""
    years = docs.select(F.col("doc_id").alias("id"), "year")

    def counts(source: str, name: str) -> DataFrame:
        c = count_documents(docs_with_topics(doc_topics, 3, source).join(years, "id", "left"))
        return c.withColumnRenamed("count", name)

    w = counts("openalex", "publication_count").alias("w")
    p = counts("patents", "patent_count").alias("p")
    cond = (F.col("w.topic") == F.col("p.topic")) & F.col("w.year").eqNullSafe(F.col("p.year"))
    joined = w.join(p, cond, "full").select(
        F.coalesce("w.topic", "p.topic").alias("topic"),
        F.coalesce("w.year", "p.year").alias("year"),
        F.coalesce("w.publication_count", F.lit(0)).alias("publication_count"),
        F.coalesce("p.patent_count", F.lit(0)).alias("patent_count"))
    return add_topic_names(
        expand_topic(joined).withColumn("total_docs", F.col("publication_count") + F.col("patent_count")),
        topic_names)


HEAVY = 2000  # citations from which a reference goes through the split plan


def cd_index(citations: DataFrame, heavy_degree: int = HEAVY) -> DataFrame:
    """CD (disruption) index of every focal work from (citing, cited) edges.

    For focal f with references R(f): among works citing f or any r in R(f)
    (f itself excluded), n_i cite only f, n_j cite f and a reference, n_k
    cite only references. CD = (n_i - n_j) / (n_i + n_j + n_k).

    Light references (up to ``heavy_degree`` citations) go through the two-hop
    join: rows "citer cites f" and "citer cites a reference of f" are unioned
    with a flag each and reduced by one aggregation on (focal, citer), which
    combines map-side; no key of the join has more than ``heavy_degree`` rows a
    side. Heavy references are never joined to their citers twice, as that has a
    row for each pair of citers: see ``_with_heavy``.
    """
    edges = citations.select("citing", "cited").distinct()
    heavy = (edges.groupBy("cited").agg(F.count("*").alias("degree")).where(F.col("degree") > heavy_degree)
             .withColumnRenamed("cited", "ref"))
    some = not heavy.isEmpty()
    if some:
        heavy = heavy.transform(lambda df: _stage(df, "heavy"))
    direct = edges.select(F.col("cited").alias("focal"), F.col("citing").alias("citer"),
                          F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    light = edges.withColumnRenamed("cited", "ref")
    if some:
        light = light.join(heavy.select("ref"), "ref", "left_anti")
    refs = light.select(F.col("citing").alias("focal"), "ref")
    ref_citers = light.select("ref", F.col("citing").alias("citer"))
    via_refs = (refs.join(ref_citers, "ref").where(F.col("citer") != F.col("focal"))
                .select("focal", "citer", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    flags = (direct.unionByName(via_refs).groupBy("focal", "citer")
             .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    a, b = F.col("_a"), F.col("_b")
    if some:
        agg = _with_heavy(flags, edges, heavy, heavy_degree)
    else:
        agg = flags.groupBy("focal").agg(
            F.sum(a * (1 - b)).cast("bigint").alias("n_only_focal"),
            F.sum(a * b).cast("bigint").alias("n_both"),
            F.sum((1 - a) * b).cast("bigint").alias("n_only_refs"))
    total = F.col("n_only_focal") + F.col("n_both") + F.col("n_only_refs")
    return (agg.withColumn("cd_score", (F.col("n_only_focal") - F.col("n_both")) / total)
            .withColumnRenamed("focal", "work_id"))


def _stage(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"cd-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _with_heavy(flags: DataFrame, edges: DataFrame, heavy: DataFrame, heavy_degree: int) -> DataFrame:
    """Counts per focal from the flags of direct citers and of citers of light
    references, and from the sets H(w) of heavy references of every work.

    A work c cites a heavy reference of f exactly when H(c) and H(f) meet, so
    pairs at hand are tested on their sets, and the number of all works whose set
    meets H(f) depends on H(f) alone: it is counted once for each distinct set,
    over distinct sets with their numbers of works. Sets that meet do so at their
    smallest common reference, where a pair of sets is counted; a reference in
    many sets is split into blocks, and so are the rows of a focal work with many
    citers.
    """
    refs = edges.withColumnRenamed("cited", "ref").join(heavy.select("ref"), "ref", "left_semi")
    sets = _stage(refs.groupBy("citing").agg(F.array_sort(F.collect_set("ref")).alias("h")), "sets")
    kinds = _stage(sets.groupBy("h").agg(F.count("*").alias("n")), "kinds")
    held = kinds.select("h", "n", F.explode("h").alias("ref"))
    parts = held.groupBy("ref").agg(F.ceil(F.count("*") / F.lit(heavy_degree)).cast("int").alias("parts"))
    held = held.join(_stage(parts, "parts"), "ref")
    x = held.select("ref", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"), F.col("h").alias("x"))
    y = held.select("ref", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("h").alias("y"), "n")
    reached = (x.join(y, ["ref", "part"]).where(F.array_min(F.array_intersect("x", "y")) == F.col("ref"))
               .groupBy("x").agg(F.sum("n").alias("reached")))
    focal = sets.join(reached, F.col("h") == F.col("x")).select(F.col("citing").alias("focal"), "h", "reached")

    salts = heavy.select(F.col("ref").alias("focal"), F.ceil(F.col("degree") / F.lit(heavy_degree)).cast("int").alias("salts"))
    one = F.coalesce("salts", F.lit(1))
    rows = flags.join(salts, "focal", "left").withColumn("salt", F.pmod(F.xxhash64("citer"), one).cast("int")).drop("salts")
    wide = (focal.join(salts, "focal", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
            .withColumnRenamed("h", "hf"))
    rows = (rows.join(sets.select(F.col("citing").alias("citer"), F.col("h").alias("hc")), "citer", "left")
            .join(wide.select("focal", "salt", "hf"), ["focal", "salt"], "left"))
    meets = F.coalesce(F.arrays_overlap("hf", "hc"), F.lit(False)) & (F.col("citer") != F.col("focal"))
    rows = rows.withColumn("_h", meets.cast("int"))
    a, b, h = F.col("_a"), F.col("_b"), F.col("_h")
    either = F.greatest(b, h)
    near = rows.groupBy("focal").agg(
        F.sum(a * (1 - either)).alias("i"), F.sum(a * either).alias("j"), F.sum(a * h).alias("jh"),
        F.sum((1 - a) * b * (1 - h)).alias("k"))
    # all works that cite a heavy reference of the focal one, but itself and those that cite it too
    far = F.coalesce(F.col("reached") - 1 - F.coalesce("jh", F.lit(0)), F.lit(0))
    out = near.join(focal.select("focal", "reached"), "focal", "full").select(
        "focal", F.coalesce("i", F.lit(0)).cast("bigint").alias("n_only_focal"),
        F.coalesce("j", F.lit(0)).cast("bigint").alias("n_both"),
        (F.coalesce("k", F.lit(0)) + far).cast("bigint").alias("n_only_refs"))
    return out.where("n_only_focal + n_both + n_only_refs > 0")


def disruption_documents(doc_topics: DataFrame, cd_scores: DataFrame, works: DataFrame) -> DataFrame:
    """Distinct (work, level-3 topic) with a CD score, plus area, domain and citations."""
    wt = docs_with_topics(doc_topics, 3, "openalex").withColumnRenamed("id", "work_id").distinct()
    return expand_topic(
        wt.join(cd_scores.select("work_id", "cd_score", "year"), "work_id")
        .join(works.select("work_id", "cited_by_count"), "work_id", "left"))


def disruption_by_level(dis_docs: DataFrame, level_col: str, interpolation: str = "nearest") -> DataFrame:
    """Per (year, id at level): quartiles and mean of CD score over distinct works."""
    d = dis_docs.select("work_id", "year", level_col, "cd_score").dropDuplicates(["work_id", level_col])
    return quartiles(d, ["year", level_col], "cd_score", f"{level_col}_cd_score", interpolation)


def level_doc_counts(dis_docs: DataFrame, level_col: str) -> DataFrame:
    return (dis_docs.select("work_id", level_col).distinct()
            .groupBy(level_col).agg(F.count("*").alias(f"{level_col}_doc_counts")))


def disruption_table(dis_docs: DataFrame, topic_names: DataFrame, top_entities: DataFrame,
                     interpolation: str = "nearest") -> DataFrame:
    """One row per (domain, area, topic, year) with all three levels' statistics.

    ``top_entities`` is (topic, entities) keyed by ids of any level.
    """
    levels = ("topic", "area", "domain")
    at = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in levels])
    long = dis_docs.select("work_id", "year", "cd_score", F.inline(at)).dropDuplicates(["work_id", "level", "name"])
    stats = quartiles(long, ["level", "year", "name"], "cd_score", "cd_score", interpolation)
    counts = long.groupBy("level", "name").agg(F.count("*").alias("n"))
    names = names_first_level_wins(topic_names)
    rows = dis_docs.select("domain", "area", "topic", "year").distinct()
    for col in levels:
        own = stats.where(F.col("level") == col).drop("level")
        rows = rows.join(own.select("year", F.col("name").alias(col), *[F.col(c).alias(f"{col}_{c}") for c in own.columns
                                                                       if c not in ("year", "name")]), ["year", col], "left")
    for col in levels:
        rows = rows.join(names.select(F.col("topic").alias(col), F.col("name").alias(f"{col}_name")), col, "left")
        rows = rows.join(top_entities.select(F.col("topic").alias(col), F.col("entities").alias(f"{col}_entities")),
                         col, "left")
        rows = rows.join(counts.where(F.col("level") == col).select(F.col("name").alias(col), F.col("n").alias(f"{col}_doc_counts")),
                         col, "left")
    return rows


def novelty_long(doc_novelty: DataFrame) -> DataFrame:
    """Distinct (level, work, topic) with novelty, year and the topic's doc count,
    from document novelty computed with ``level`` as a key: a row per level and work,
    so that topics are made distinct inside the row."""
    out = doc_novelty.select("level", "work_id", "year", "novelty", F.explode(F.array_distinct("topics")).alias("topic"))
    counts = out.groupBy("level", "topic").agg(F.count("*").alias("doc_counts"))
    return out.join(counts, ["level", "topic"])


def novelty_documents(nov_long: DataFrame) -> DataFrame:
    """Level-3 rows with domain and area."""
    return expand_topic(nov_long.where(F.col("level") == 3)).select(
        "work_id", "year", "novelty", "domain", "area", "topic")


def document_names(works: DataFrame, nov_docs: DataFrame) -> DataFrame:
    return (works.select("work_id", "display_name")
            .join(nov_docs.select("work_id").distinct(), "work_id", "left_semi")
            .dropDuplicates(["work_id"]))


def novelty_trends(nov_long: DataFrame, topic_names: DataFrame, top_entities: DataFrame,
                   interpolation: str = "nearest") -> DataFrame:
    """Per level-3 topic and year: the topic's novelty quartiles and those of
    its area and domain in the same year, with names, entities, doc counts."""
    stats = quartiles(nov_long, ["level", "topic", "year"], "novelty", "novelty", interpolation)
    counts = nov_long.select("level", "topic", "doc_counts").distinct()
    stats = stats.join(counts, ["level", "topic"])
    names = names_first_level_wins(topic_names)

    def at(level: int, col: str) -> DataFrame:
        s = stats.where(F.col("level") == level).drop("level")
        return s.select(F.col("topic").alias(col), "year",
                        *[F.col(c).alias(f"{col}_{c}") for c in s.columns if c not in ("topic", "year")])

    rows = expand_topic(at(3, "topic"), "topic")
    rows = rows.join(at(2, "area"), ["area", "year"], "left").join(at(1, "domain"), ["domain", "year"], "left")
    for col in ("topic", "area", "domain"):
        rows = rows.join(names.select(F.col("topic").alias(col), F.col("name").alias(f"{col}_name")), col, "left")
        rows = rows.join(top_entities.select(F.col("topic").alias(col), F.col("entities").alias(f"{col}_entities")),
                         col, "left")
    return rows


def scores_combined(cd_scores: DataFrame, doc_novelty: DataFrame) -> DataFrame:
    c = cd_scores.select(F.col("work_id").alias("id"), "cd_score", F.col("year").alias("_cy"))
    n = doc_novelty.select(F.col("work_id").alias("id"), "novelty", F.col("year").alias("_ny"))
    return (c.join(n, "id", "full")
            .select("id", "cd_score", "novelty", F.coalesce("_cy", "_ny").alias("year")))


def publication_org_rows(doc_topics: DataFrame, doc_orgs: DataFrame) -> DataFrame:
    """(id, topic, org) for works: topics joined to authorship rows with an affiliation."""
    t = docs_with_topics(doc_topics, 3, "openalex")
    a = doc_orgs.select(F.col("doc_id").alias("id"), F.col("org")).where(F.col("org").isNotNull())
    return t.join(a, "id")


def org_quad(scores: DataFrame, org_rows: DataFrame, topic_names: DataFrame) -> DataFrame:
    """Per (org, topic, year): author-row volume, mean CD score, mean novelty."""
    agg = (scores.join(org_rows, "id", "left")
           .groupBy(F.col("org").alias("affiliation_string"), "topic", "year")
           .agg(F.count("id").alias("volume"), F.avg("cd_score").alias("average_cd_score"),
                F.avg("novelty").alias("average_novelty_score")))
    return add_topic_names(expand_topic(agg), topic_names).drop("domain", "area", "topic")


def dashboard_sample(ids: DataFrame, names: DataFrame, novelty: DataFrame, disruption: DataFrame,
                     entity_index: DataFrame) -> dict[str, DataFrame]:
    """The dashboard's document tables, each cut to the documents ``ids`` (work_id), so
    that a sampled document is in all of them and another in none."""
    def cut(df: DataFrame, key: str) -> DataFrame:
        return df.join(ids.select(F.col("work_id").alias(key)), key, "left_semi")
    return {"names": cut(names, "work_id"), "novelty": cut(novelty, "work_id"), "disruption": cut(disruption, "work_id"),
            "entities": cut(entity_index, "document")}


def topic_lookup(doc_topics: DataFrame, topic_names: DataFrame, source: str | None = None) -> DataFrame:
    t = docs_with_topics(doc_topics, 3, source).select("topic").distinct()
    return add_topic_names(expand_topic(t), topic_names)


def docs_per_org(org_rows: DataFrame, id_col: str = "id", org_col: str = "org",
                 top_n: int | None = None) -> DataFrame:
    out = (org_rows.select(id_col, org_col).distinct()
           .groupBy(org_col).agg(F.count("*").alias("n_docs")))
    if top_n:
        out = out.orderBy(F.col("n_docs").desc(), F.col(org_col)).limit(top_n)
    return out


def topic_levels(topic: Column) -> Column:
    """The (level, name) of a topic at all three levels."""
    names = {"domain": F.substring_index(topic, "_", 1), "area": F.substring_index(topic, "_", 2), "topic": topic}
    return F.array(*[F.struct(F.lit(lvl).alias("level"), name.alias("name")) for lvl, name in names.items()])


def by_topic_level(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Each row at all three levels: ``level`` (domain, area, topic) and ``name``, its topic there."""
    own = [c for c in df.columns if c != topic]
    return df.select(*own, F.inline(topic_levels(F.col(topic))))


def org_topics(org_rows: DataFrame, by: str | list[str] = "topic", org_col: str = "org") -> DataFrame:
    """Long org -> domain/area/topic with the number of rows (duplicates kept)."""
    return org_rows.groupBy(org_col, *([by] if isinstance(by, str) else by)).agg(F.count("*").alias("n_rows"))


def collaboration_edges(org_rows: DataFrame, id_col: str = "id", org_col: str = "org",
                        by: str | list[str] | None = None, chunk: int = DEFAULT_CHUNK,
                        at: Callable[[Column], Column] | None = None) -> DataFrame:
    """Unordered organisation pairs with the number of documents they share
    (per ``by`` group when given; with ``at``, per group of the array that it makes
    of the ``by`` column).

    A document's organisations meet once, inside its row, whatever the number of its
    groups: a pair carries the groups that both organisations hold there as a list,
    which is written out where the documents of a pair are counted. Tasks are as
    many as the counted rows ask for. Documents with more than ``chunk``
    organisations are split by salting."""
    by = [by] if isinstance(by, str) else by or []
    d = org_rows.select(F.col(id_col).alias("_id"), F.col(org_col).alias("_org"), *by)
    for c in d.columns:
        d = d.where(F.col(c).isNotNull())
    if at:
        held = F.array_distinct(F.flatten(F.transform(F.collect_set(by[0]), at)))
    else:
        held = F.collect_set(F.struct(*by)) if by else F.array(F.struct(F.max(F.lit(1))))
    path = scratch_path(org_rows.sparkSession, "organisations")
    d.groupBy("_id", "_org").agg(F.array_sort(held).alias("_held")).write.parquet(path)
    member = org_rows.sparkSession.read.parquet(path).select("_id", F.struct("_org", "_held").alias("_m"))
    sizes = member.groupBy("_id").agg(F.count("*").alias("_n"), F.max(F.size("_m._held")).alias("_h"))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    many, rows, hot = sizes.agg(F.sum(pairs), F.sum(pairs * F.col("_h")), F.count_if(F.col("_n") > chunk)).first()
    if hot:
        big = sizes.where(F.col("_n") > chunk).select("_id")
        met = pairs_within(member.join(big, "_id", "left_semi"), ["_id"], "_m", "_a", "_b", chunk=chunk).select("_a", "_b")
        member = member.join(big, "_id", "left_anti")
    inside = (member.repartition(int((many or 0) // PAIRS_A_TASK) + 1, "_id")
              .groupBy("_id").agg(F.array_sort(F.collect_list("_m")).alias("_ms"))
              .select("_ms", F.posexplode("_ms").alias("_i", "_a"))
              .select("_a", F.explode(F.slice("_ms", F.col("_i") + 2, F.size("_ms"))).alias("_b")))
    met = inside.unionByName(met) if hot else inside
    shared = (F.when(F.col("_a._held") == F.col("_b._held"), F.col("_a._held"))
              .otherwise(F.array_intersect("_a._held", "_b._held")))
    met = (met.select(F.col("_a._org").alias("org_1"), F.col("_b._org").alias("org_2"), *([shared.alias("_held")] if by else []))
           .repartition(int((rows or 0) // ROWS_A_TASK) + 1, "org_1", "org_2"))
    if by:
        met = met.select("org_1", "org_2", F.inline("_held"))
        by = [c for c in met.columns if c not in ("org_1", "org_2")]
    return met.groupBy(*by, "org_1", "org_2").agg(F.count("*").alias("n_docs"))


def collaboration_network(org_rows: DataFrame, top_n: int = 500, id_col: str = "id",
                          org_col: str = "org") -> tuple[DataFrame, DataFrame]:
    """Nodes (top-N organisations by documents) and the edges among them."""
    nodes = docs_per_org(org_rows, id_col, org_col, top_n)
    keep = nodes.select(org_col)
    edges = collaboration_edges(org_rows.join(keep, org_col, "left_semi"), id_col, org_col)
    return nodes, edges


def ln_size(c: str | Column) -> Column:
    return F.log(F.col(c) if isinstance(c, str) else c)
