"""Registered queries for topic-pair novelty (2.D).

The oracle recomputes everything from the definitions in SQL: pairs by a
self-join, N_i(t) as the sum of pair counts containing i, N_t as the sum of
all pair counts, percentiles with ``quantile_cont``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import novelty as N
from .registry import finish, query, tables
from .views_sql import with_views

LEVEL = 3
TOPIC_LEVEL = 1
YEAR = 1997


def _topics(spark, sf):
    """Document -> topic tags of all levels, staged once per session."""
    t = tables(spark, sf)
    return E.long_tags(t.stage("doc_tags", lambda: E.tag_mentions(t.doc_entities, t.taxonomy), ("source",)))


def _novelty_in(spark, sf, level=LEVEL, source="openalex", id_column="work_id"):
    """Per-document distinct topics, staged: the novelty plan reads it in four
    branches (pairs, pair activity, yearly totals, document pairs)."""
    t = tables(spark, sf)
    return t.stage(f"novelty_in_{level}_{source}_{id_column}",
                   lambda: N.novelty_input(_topics(spark, sf), t.docs, level, source, id_column))


def _oracle_ctes(level: int, source: str = "openalex", p: str = "") -> dict[str, str]:
    """Novelty CTEs; ``p`` prefixes every name so two sources can share a query."""
    return {
        f"{p}nin": f"""
SELECT d.doc_id AS work_id, CAST(m.year AS INT) AS year, d.topic
FROM (SELECT DISTINCT doc_id, topic FROM doc_topics WHERE level = {level} AND source = '{source}') d
JOIN (SELECT DISTINCT doc_id, year FROM docs WHERE source = '{source}') m ON d.doc_id = m.doc_id
WHERE m.year IS NOT NULL""",
        f"{p}nin_docs": f"""
SELECT work_id, year, count(*) AS n_topics, string_agg(topic, ',' ORDER BY topic) AS topics
FROM {p}nin GROUP BY work_id, year HAVING count(*) >= 2""",
        f"{p}ntop": f"SELECT n.work_id, n.year, n.topic FROM {p}nin n JOIN {p}nin_docs d ON n.work_id = d.work_id",
        f"{p}pairs": f"""
SELECT a.work_id, a.year, a.topic AS topic_1, b.topic AS topic_2
FROM {p}ntop a JOIN {p}ntop b ON a.work_id = b.work_id AND a.topic < b.topic""",
        f"{p}pcounts": f"SELECT topic_1, topic_2, year, count(*) AS N_ij_t FROM {p}pairs GROUP BY topic_1, topic_2, year",
        f"{p}memb": f"""
SELECT topic, year, CAST(sum(N_ij_t) AS BIGINT) AS N_i_t FROM (
  SELECT topic_1 AS topic, year, N_ij_t FROM {p}pcounts UNION ALL SELECT topic_2, year, N_ij_t FROM {p}pcounts) u
GROUP BY topic, year""",
        f"{p}tot": f"SELECT year, CAST(sum(N_ij_t) AS BIGINT) AS N_t FROM {p}pcounts GROUP BY year",
        f"{p}comm": f"""
SELECT p.topic_1, p.topic_2, p.year, p.N_ij_t, a.N_i_t, b.N_i_t AS N_j_t, t.N_t,
  CAST(p.N_ij_t AS DOUBLE) * t.N_t / (a.N_i_t * b.N_i_t) AS commonness
FROM {p}pcounts p JOIN {p}memb a ON a.topic = p.topic_1 AND a.year = p.year
JOIN {p}memb b ON b.topic = p.topic_2 AND b.year = p.year JOIN {p}tot t ON t.year = p.year""",
        f"{p}dnov": f"""
SELECT p.work_id, p.year, quantile_cont(c.commonness, 0.1) AS commonness, -ln(quantile_cont(c.commonness, 0.1)) AS novelty
FROM {p}pairs p JOIN {p}comm c ON p.topic_1 = c.topic_1 AND p.topic_2 = c.topic_2 AND p.year = c.year
GROUP BY p.work_id, p.year""",
        f"{p}tdn": f"""
SELECT t.topic, d.year, quantile_cont(d.novelty, 0.5) AS topic_doc_novelty, count(*) AS doc_counts
FROM {p}dnov d JOIN {p}ntop t ON d.work_id = t.work_id GROUP BY t.topic, d.year""",
    }


def _tpn_cte(min_counts: int) -> str:
    return f"""
SELECT topic, year, quantile_cont(commonness, 0.1) AS topic_pair_commonness, CAST(sum(N_ij_t) AS BIGINT) AS pair_counts,
  -ln(quantile_cont(commonness, 0.1)) AS topic_pair_novelty
FROM (SELECT topic_1 AS topic, year, commonness, N_ij_t FROM comm WHERE N_ij_t > {min_counts}
      UNION ALL SELECT topic_2, year, commonness, N_ij_t FROM comm WHERE N_ij_t > {min_counts}) u
GROUP BY topic, year"""


def _o(body: str, level: int = LEVEL, source: str = "openalex", extra: dict | None = None) -> str:
    ctes = _oracle_ctes(level, source)
    ctes.update(extra or {})
    return with_views(body, "doc_topics", "docs", extra=ctes)


@query("novelty_input", oracle=_o(
    "SELECT work_id, year, CAST(n_topics AS INT) AS n_topics, topics FROM nin_docs"))
def q_novelty_input(spark, sf):
    return finish(_novelty_in(spark, sf), lists=("topics",))


@query("document_topic_pairs", oracle=_o(
    "SELECT work_id, topic_1, topic_2, year, topic_1 || '_x_' || topic_2 AS topic_pair FROM pairs"))
def q_document_topic_pairs(spark, sf):
    return N.document_topic_pairs(_novelty_in(spark, sf))


@query("topic_pair_counts", oracle=_o(
    "SELECT topic_1, topic_2, topic_1 || '_x_' || topic_2 AS topic_pair, year, N_ij_t AS counts FROM pcounts"))
def q_topic_pair_counts(spark, sf):
    return N.topic_pair_counts(N.document_topic_pairs(_novelty_in(spark, sf)))


@query("topic_pair_membership", oracle=_o("SELECT topic, year, N_i_t AS counts FROM memb"))
def q_topic_pair_membership(spark, sf):
    return N.topic_pair_membership(_novelty_in(spark, sf))


@query("topic_pair_commonness", oracle=_o("""
SELECT topic_1, topic_2, topic_1 || '_x_' || topic_2 AS topic_pair, year, N_ij_t, N_i_t, N_j_t, N_t,
  round(commonness, 6) AS commonness FROM comm"""))
def q_topic_pair_commonness(spark, sf):
    return finish(N.topic_pair_commonness(_novelty_in(spark, sf)), floats=("commonness",))


_DOC_NOV_SQL = """
SELECT d.work_id, d.year, round(d.commonness, 6) AS commonness, round(d.novelty, 6) AS novelty,
  CAST(n.n_topics AS INT) AS n_topics, n.topics
FROM dnov d JOIN nin_docs n ON d.work_id = n.work_id"""


@query("document_novelty", oracle=_o(_DOC_NOV_SQL))
def q_document_novelty(spark, sf):
    return finish(N.document_novelty(_novelty_in(spark, sf)), floats=("commonness", "novelty"), lists=("topics",))


@query("patent_novelty", oracle=_o(_DOC_NOV_SQL.replace("d.work_id,", "d.work_id AS publication_number,", 1),
                                   source="patents"))
def q_patent_novelty(spark, sf):
    nin = _novelty_in(spark, sf, source="patents", id_column="publication_number")
    return finish(N.document_novelty(nin, "publication_number"), floats=("commonness", "novelty"),
                  lists=("topics",))


@query("topic_document_novelty", oracle=_o(
    "SELECT topic, year, round(topic_doc_novelty, 6) AS topic_doc_novelty, doc_counts FROM tdn"))
def q_topic_document_novelty(spark, sf):
    return finish(N.topic_document_novelty(N.document_novelty(_novelty_in(spark, sf))),
                  floats=("topic_doc_novelty",))


@query("topic_pair_novelty", oracle=_o("""
SELECT topic, year, round(topic_pair_commonness, 6) AS topic_pair_commonness, pair_counts,
  round(topic_pair_novelty, 6) AS topic_pair_novelty FROM tpn""", extra={"tpn": _tpn_cte(0)}))
def q_topic_pair_novelty(spark, sf):
    return finish(N.topic_pair_novelty(N.topic_pair_commonness(_novelty_in(spark, sf)), 0),
                  floats=("topic_pair_commonness", "topic_pair_novelty"))


def _topic_novelty(spark, sf, level=TOPIC_LEVEL):
    t = tables(spark, sf)
    nin = _novelty_in(spark, sf, level=level)
    comm = N.topic_pair_commonness(nin)
    return N.topic_novelty(N.document_novelty(nin, commonness=comm), comm, t.topic_names, level, 50, 50)


_TOPIC_NOV_SQL = """
SELECT d.topic, d.year, round(d.topic_doc_novelty, 6) AS topic_doc_novelty, d.doc_counts,
  round(p.topic_pair_commonness, 6) AS topic_pair_commonness, p.pair_counts,
  round(p.topic_pair_novelty, 6) AS topic_pair_novelty, n.name AS topic_name
FROM tdn d LEFT JOIN tpn p ON d.topic = p.topic AND d.year = p.year
LEFT JOIN (SELECT topic, name FROM topic_names WHERE level = {level}) n ON d.topic = n.topic
WHERE d.doc_counts > 50"""


def _o_topic(body: str) -> str:
    ctes = _oracle_ctes(TOPIC_LEVEL)
    ctes["tpn"] = _tpn_cte(50)
    ctes["tnov"] = _TOPIC_NOV_SQL.format(level=TOPIC_LEVEL)
    return with_views(body, "doc_topics", "docs", "topic_names", extra=ctes)


_TN_FLOATS = ("topic_doc_novelty", "topic_pair_commonness", "topic_pair_novelty")


@query("topic_novelty", oracle=_o_topic("SELECT * FROM tnov"))
def q_topic_novelty(spark, sf):
    return finish(_topic_novelty(spark, sf), floats=_TN_FLOATS)


@query("topic_to_documents", oracle=_o("""
SELECT t.topic, d.work_id, w.display_name, round(d.novelty, 6) AS novelty, d.year, CAST(n.n_topics AS INT) AS n_topics
FROM dnov d JOIN ntop t ON d.work_id = t.work_id JOIN nin_docs n ON d.work_id = n.work_id
LEFT JOIN works w ON d.work_id = w.work_id"""))
def q_topic_to_documents(spark, sf):
    t = tables(spark, sf)
    return finish(N.topic_to_documents(N.document_novelty(_novelty_in(spark, sf)), t.docs), floats=("novelty",))


@query("top_novel_topics", oracle=_o_topic(f"""
SELECT * FROM tnov WHERE year = {YEAR} ORDER BY topic_doc_novelty DESC, topic LIMIT 3"""))
def q_top_novel_topics(spark, sf):
    return N.top_novel_topics(finish(_topic_novelty(spark, sf), floats=_TN_FLOATS), YEAR, True, 3)


@query("top_novel_documents", oracle=_o(f"""
SELECT d.work_id, d.year, round(d.commonness, 6) AS commonness, round(d.novelty, 6) AS novelty,
  CAST(n.n_topics AS INT) AS n_topics, n.topics, w.display_name
FROM dnov d JOIN nin_docs n ON d.work_id = n.work_id LEFT JOIN works w ON d.work_id = w.work_id
WHERE d.year = {YEAR} AND n.n_topics >= 3 AND ',' || n.topics || ',' LIKE '%,0_1_2,%'
ORDER BY round(d.novelty, 6) DESC, d.work_id LIMIT 20"""))
def q_top_novel_documents(spark, sf):
    t = tables(spark, sf)
    dn = finish(N.document_novelty(_novelty_in(spark, sf)), floats=("commonness", "novelty"))
    out = N.top_novel_documents(dn, t.docs, YEAR, topic="0_1_2", most_novel=True, top_n=20, min_topics=3)
    return out.withColumn("topics", F.array_join("topics", ","))


@query("documents_with_text", oracle=_o("""
SELECT w.work_id, w.display_name, round(d.novelty, 6) AS novelty, CAST(n.n_topics AS INT) AS n_topics
FROM works w JOIN dnov d ON w.work_id = d.work_id JOIN nin_docs n ON w.work_id = n.work_id
WHERE regexp_matches(lower(w.display_name), 'order [0-9]*7$') AND n.n_topics >= 3"""))
def q_documents_with_text(spark, sf):
    t = tables(spark, sf)
    dn = N.document_novelty(_novelty_in(spark, sf))
    docs = t.docs.where(F.col("source") == "openalex")
    return finish(N.documents_with_text(docs, dn, "order [0-9]*7$", min_n_topics=3), floats=("novelty",))


@query("combine_novelty_sources", oracle=with_views("""
SELECT topic, year, round(topic_doc_novelty, 6) AS topic_doc_novelty, doc_counts, 'Research publications' AS source FROM w_tdn
UNION ALL
SELECT topic, year, round(topic_doc_novelty, 6), doc_counts, 'Patents' FROM p_tdn""", "doc_topics", "docs",
    extra={**_oracle_ctes(LEVEL, "openalex", "w_"), **_oracle_ctes(LEVEL, "patents", "p_")}))
def q_combine_novelty_sources(spark, sf):
    w = N.topic_document_novelty(N.document_novelty(_novelty_in(spark, sf)))
    p = N.topic_document_novelty(N.document_novelty(
        _novelty_in(spark, sf, source="patents", id_column="publication_number"), "publication_number"),
        "publication_number")
    return finish(N.combine_novelty_sources(w, p), floats=("topic_doc_novelty",))


# -- novelty charts -------------------------------------------------------------------
START, END = 1996, 1998


def _tdn(spark, sf, source="openalex"):
    idc = "work_id" if source == "openalex" else "publication_number"
    nin = _novelty_in(spark, sf, source=source, id_column=idc)
    return N.topic_document_novelty(N.document_novelty(nin, idc), idc)


def _growth(spark, sf):
    t = tables(spark, sf)
    names = t.topic_names.where(F.col("level") == LEVEL).select("topic", F.col("name").alias("topic_name"))
    return N.novelty_growth(_tdn(spark, sf), START, END).join(names, "topic", "left")


_GROWTH_CTE = f"""
SELECT g.topic, g.avg_novelty, g.growth, g.doc_counts, n.name AS topic_name FROM (
  SELECT topic, avg(CASE WHEN year BETWEEN {START} AND {END} THEN topic_doc_novelty END) AS avg_novelty,
    (avg(CASE WHEN year BETWEEN {END - 2} AND {END - 1} THEN topic_doc_novelty END)
     - avg(CASE WHEN year BETWEEN {START - 2} AND {START - 1} THEN topic_doc_novelty END))
     / avg(CASE WHEN year BETWEEN {START - 2} AND {START - 1} THEN topic_doc_novelty END) AS growth,
    sum(CASE WHEN year BETWEEN {START} AND {END} THEN doc_counts END) AS doc_counts
  FROM tdn GROUP BY topic) g
LEFT JOIN (SELECT topic, name FROM topic_names WHERE level = {LEVEL}) n ON g.topic = n.topic"""


def _o_growth(body: str) -> str:
    ctes = _oracle_ctes(LEVEL)
    ctes["gr"] = _GROWTH_CTE
    return with_views(body, "doc_topics", "docs", "topic_names", extra=ctes)


_GR_FLOATS = ("avg_novelty", "growth")


@query("novelty_growth", oracle=_o_growth("""
SELECT topic, round(avg_novelty, 6) AS avg_novelty, round(growth, 6) AS growth, CAST(doc_counts AS BIGINT) AS doc_counts,
  topic_name FROM gr"""))
def q_novelty_growth(spark, sf):
    return finish(_growth(spark, sf), floats=_GR_FLOATS)


@query("top_growth_topics", oracle=_o_growth("""
SELECT topic, round(avg_novelty, 6) AS avg_novelty, round(growth, 6) AS growth, CAST(doc_counts AS BIGINT) AS doc_counts,
  topic_name FROM gr WHERE growth IS NOT NULL ORDER BY round(growth, 6) DESC, topic LIMIT 5"""))
def q_top_growth_topics(spark, sf):
    return N.top_growth_topics(finish(_growth(spark, sf), floats=_GR_FLOATS), 5)


@query("novelty_quadrant", oracle=_o_growth("""
SELECT topic, round(avg_novelty, 6) AS avg_novelty, round(growth, 6) AS growth, CAST(doc_counts AS BIGINT) AS doc_counts,
  topic_name, round(abs(growth), 6) AS abs_growth,
  CASE WHEN growth > 0 AND avg_novelty < m THEN 'emerging' WHEN growth > 0 THEN 'hot'
       WHEN avg_novelty >= m THEN 'stable uncommon' ELSE 'stable common' END AS quadrant
FROM gr CROSS JOIN (SELECT quantile_cont(avg_novelty, 0.5) AS m FROM gr) x WHERE growth <> 0"""))
def q_novelty_quadrant(spark, sf):
    return finish(N.novelty_quadrant(_growth(spark, sf)), floats=_GR_FLOATS + ("abs_growth",))


@query("novelty_vs_popularity", oracle=_o("""
SELECT topic, year, round(topic_doc_novelty, 6) AS topic_doc_novelty, doc_counts FROM tdn
WHERE year = 1996 AND doc_counts >= 50"""))
def q_novelty_vs_popularity(spark, sf):
    return finish(N.novelty_vs_popularity(_tdn(spark, sf), 1996, 50), floats=("topic_doc_novelty",))


@query("novelty_timeseries", oracle=_o("""
SELECT topic, year, round(topic_doc_novelty, 6) AS topic_doc_novelty, doc_counts FROM tdn
WHERE topic IN ('0_1_2', '2_2_0', '3_0_1')"""))
def q_novelty_timeseries(spark, sf):
    sel = spark.createDataFrame([("0_1_2",), ("2_2_0",), ("3_0_1",)], "topic string")
    return finish(N.novelty_timeseries(_tdn(spark, sf), sel), floats=("topic_doc_novelty",))


@query("novelty_zscore_wide", oracle=with_views("""
SELECT w.topic, round(w.OpenAlex, 6) AS OpenAlex, round(w.Patents, 6) AS Patents,
  round((w.OpenAlex - s.mo) / s.so, 6) AS openalex_zscore, round((w.Patents - s.mp) / s.sp, 6) AS patents_zscore
FROM wide w CROSS JOIN (SELECT avg(OpenAlex) AS mo, stddev_samp(OpenAlex) AS so, avg(Patents) AS mp,
                               stddev_samp(Patents) AS sp FROM wide) s""", "doc_topics", "docs", extra={
    **_oracle_ctes(LEVEL, "openalex", "w_"), **_oracle_ctes(LEVEL, "patents", "p_"),
    "wide": """SELECT coalesce(a.topic, b.topic) AS topic, a.topic_doc_novelty AS OpenAlex, b.topic_doc_novelty AS Patents
      FROM (SELECT * FROM w_tdn WHERE year = 1996) a FULL OUTER JOIN (SELECT * FROM p_tdn WHERE year = 1996) b
      ON a.topic = b.topic"""}))
def q_novelty_zscore_wide(spark, sf):
    comb = N.combine_novelty_sources(_tdn(spark, sf), _tdn(spark, sf, "patents"))
    return finish(N.novelty_zscore_wide(comb, 1996),
                  floats=("OpenAlex", "Patents", "openalex_zscore", "patents_zscore"))
