"""Registered dashboard queries (2.F) over the indicator tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboards as D
from ..operators import entities as E
from ..operators import indicators as I
from . import q_indicators as QI
from .q_novelty import _oracle_ctes
from .registry import finish, query, tables
from .sqlhelp import mean6
from .views_sql import with_views

YEARS = (1996, 1999)
DOMAIN = "Name 1"
AREA_ID = "1_2"


def _volume(spark, sf):
    t = tables(spark, sf)
    return I.volume_table(QI._topics(spark, sf), t.docs, t.topic_names)


def _dis_table(spark, sf):
    t = tables(spark, sf)
    return I.disruption_table(QI._dis_docs(spark, sf), t.topic_names, QI._top_entities(spark, sf))


def _nov_trends(spark, sf):
    t = tables(spark, sf)
    return I.novelty_trends(QI._nov_long(spark, sf), t.topic_names, QI._top_entities(spark, sf))


# -- oracle building blocks --------------------------------------------------
def _vol(body: str, extra=None) -> str:
    ex = dict(QI.VOLUME_CTES)
    ex["vol"] = QI.VOLUME_SQL
    ex.update(extra or {})
    return with_views(body, "doc_topics", "docs", "topic_names", extra=ex)


ALIGN = """
SELECT topic, year, domain, area, domain_name, area_name, topic_name, 'publication_count' AS doc_type, publication_count AS count FROM vol
UNION ALL
SELECT topic, year, domain, area, domain_name, area_name, topic_name, 'patent_count', patent_count FROM vol"""


def _dis(body: str, extra=None) -> str:
    ex = dict(QI.DIS)
    ex.update(QI.TOPENT)
    ex["names"] = QI.NAMES
    ex["dt"] = QI.DIS_TABLE_SQL
    ex.update(extra or {})
    return with_views(body, "doc_topics", "cd_scores", "works", "topic_names", "doc_entities", "taxonomy", extra=ex)


def _nov(body: str, extra=None) -> str:
    ex = dict(QI._NL)
    ex.update(QI._NT)
    ex.update(QI.TOPENT)
    ex["names"] = QI.NAMES
    ex["nt"] = QI.NOV_TRENDS_SQL
    ex.update(extra or {})
    return with_views(body, "doc_topics", "docs", "topic_names", "doc_entities", "taxonomy", "works", extra=ex)


# -- volume / alignment --------------------------------------------------------
@query("alignment_long", oracle=_vol(ALIGN))
def q_alignment_long(spark, sf):
    return D.alignment_long(_volume(spark, sf).drop("total_docs"))


@query("filter_by_domain", oracle=_vol(f"SELECT * FROM vol WHERE domain_name = '{DOMAIN}'"))
def q_filter_by_domain(spark, sf):
    return D.filter_by(_volume(spark, sf), "domain", DOMAIN)


@query("filter_by_area", oracle=_vol("SELECT * FROM vol WHERE area_name = 'Name 1_2'"))
def q_filter_by_area(spark, sf):
    return D.filter_by(_volume(spark, sf), "area", "Name 1_2")


@query("filter_by_topic", oracle=_dis("SELECT * FROM dt WHERE topic_name = 'Name 1_2_0'"))
def q_filter_by_topic(spark, sf):
    return finish(D.filter_by(_dis_table(spark, sf), "topic", "Name 1_2_0"), floats=QI._DT_FLOATS)


@query("filter_options", oracle=_vol(
    f"SELECT DISTINCT area_name AS option FROM vol WHERE domain_name = '{DOMAIN}' AND area_name IS NOT NULL"))
def q_filter_options(spark, sf):
    return D.next_level_options(D.filter_by(_volume(spark, sf), "domain", DOMAIN), "area")


@query("emergence_by_level", oracle=_vol("""
SELECT area, area_name, year, CAST(sum(total_docs) AS BIGINT) AS total_docs FROM vol WHERE year IS NOT NULL
GROUP BY area, area_name, year"""))
def q_emergence_by_level(spark, sf):
    return D.emergence_by_level(_volume(spark, sf), "area", "total_docs")


@query("alignment_by_level", oracle=_vol(f"""
SELECT g.doc_type, g.area, g.area_name, g.total, round(g.total / t.s, 6) AS doc_fraction,
  CASE WHEN g.doc_type = 'publication_count' THEN 'Publications' ELSE 'Patents' END AS doc_name_clean,
  round(g.total / t.s * 100, 6) AS doc_percentage
FROM (SELECT doc_type, area, area_name, CAST(sum(count) AS BIGINT) AS total FROM al GROUP BY doc_type, area, area_name) g
JOIN (SELECT doc_type, sum(count) AS s FROM al GROUP BY doc_type) t ON g.doc_type = t.doc_type""",
    extra={"al": f"SELECT * FROM ({ALIGN}) a WHERE domain_name = '{DOMAIN}'"}))
def q_alignment_by_level(spark, sf):
    al = D.filter_by(D.alignment_long(_volume(spark, sf).drop("total_docs")), "domain", DOMAIN)
    return finish(D.alignment_by_level(al, "area"), floats=("doc_fraction", "doc_percentage"))


# -- novelty / disruption views -------------------------------------------------
NOV_MEASURES = ["doc_counts", "novelty50", "entities"]
DIS_MEASURES = ["doc_counts", "cd_score50", "cd_score_mean", "entities"]


def _lv_sql(src: str, measures: list[str], floats: tuple = ()) -> str:
    cols = ", ".join((f"round(area_{m}, 6) AS {m}" if m in floats else f"area_{m} AS {m}") for m in measures)
    return f"""SELECT DISTINCT area, year, area_name AS name, {cols} FROM {src}
WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]}"""


@query("novelty_by_level", oracle=_nov(_lv_sql("nt", NOV_MEASURES, ("novelty50",))))
def q_novelty_by_level(spark, sf):
    v = D.level_view(_nov_trends(spark, sf), "area", YEARS, NOV_MEASURES)
    return finish(v, floats=("novelty50",))


@query("novelty_by_level_docs", oracle=_nov(f"""
SELECT DISTINCT d.work_id AS document_link, d.year AS document_year, d.area, n.name, round(d.novelty, 6) AS novelty
FROM (SELECT work_id, year, novelty, {QI.EXP} FROM nl WHERE level = 3) d
LEFT JOIN (SELECT DISTINCT area, name FROM ({_lv_sql('nt', NOV_MEASURES)}) v) n ON d.area = n.area
WHERE d.year BETWEEN {YEARS[0]} AND {YEARS[1]}"""))
def q_novelty_by_level_docs(spark, sf):
    v = D.level_view(_nov_trends(spark, sf), "area", YEARS, NOV_MEASURES)
    docs = I.novelty_documents(QI._nov_long(spark, sf))
    return finish(D.level_docs(docs, v, "area", YEARS, "novelty"), floats=("novelty",))


@query("disruption_by_level", oracle=_dis(_lv_sql("dt", DIS_MEASURES, ("cd_score50", "cd_score_mean"))))
def q_disruption_by_level(spark, sf):
    v = D.level_view(_dis_table(spark, sf), "area", YEARS, DIS_MEASURES)
    return finish(v, floats=("cd_score50", "cd_score_mean"))


@query("novelty_weighted_by_level", oracle=_nov(f"""
SELECT v.area, CAST(sum(v.doc_counts) AS BIGINT) AS doc_counts,
  {mean6('v.novelty50', 'v.doc_counts', 6)} AS novelty50, n.name
FROM ({_lv_sql('nt', NOV_MEASURES)}) v
LEFT JOIN (SELECT DISTINCT area, name FROM ({_lv_sql('nt', NOV_MEASURES)}) v2) n ON v.area = n.area
GROUP BY v.area, n.name"""))
def q_novelty_weighted_by_level(spark, sf):
    v = D.level_view(_nov_trends(spark, sf), "area", YEARS, NOV_MEASURES)
    return finish(D.weighted_by_level(v, "area", YEARS, "novelty50"), floats=("novelty50",))


@query("disruption_weighted_by_level", oracle=_dis(f"""
SELECT v.area, CAST(sum(v.doc_counts) AS BIGINT) AS doc_counts,
  {mean6('v.cd_score_mean', 'v.doc_counts', 6)} AS cd_score_mean, n.name
FROM ({_lv_sql('dt', DIS_MEASURES)}) v
LEFT JOIN (SELECT DISTINCT area, name FROM ({_lv_sql('dt', DIS_MEASURES)}) v2) n ON v.area = n.area
GROUP BY v.area, n.name"""))
def q_disruption_weighted_by_level(spark, sf):
    v = D.level_view(_dis_table(spark, sf), "area", YEARS, DIS_MEASURES)
    return finish(D.weighted_by_level(v, "area", YEARS, "cd_score_mean"), floats=("cd_score_mean",))


@query("yearly_rank", oracle=_nov(f"""
SELECT area, year, name, doc_counts, round(novelty50, 6) AS novelty50, entities,
  rank() OVER (PARTITION BY year ORDER BY novelty50) AS rank
FROM ({_lv_sql('nt', NOV_MEASURES)}) v"""))
def q_yearly_rank(spark, sf):
    v = D.level_view(_nov_trends(spark, sf), "area", YEARS, NOV_MEASURES)
    return finish(D.yearly_rank(v, "novelty50"), floats=("novelty50",))


@query("disruption_interval", oracle=_dis(f"""
SELECT n.name, d.year, {mean6('d.cd_score')} AS mean, round(quantile_cont(d.cd_score, 0.1), 6) AS p10,
  round(quantile_cont(d.cd_score, 0.9), 6) AS p90
FROM (SELECT DISTINCT work_id, year, area, cd_score FROM dd) d
LEFT JOIN (SELECT topic, name FROM topic_names WHERE level = 2) n ON d.area = n.topic
GROUP BY n.name, d.year"""))
def q_disruption_interval(spark, sf):
    t = tables(spark, sf)
    d = QI._dis_docs(spark, sf).select("work_id", "year", "area", "cd_score").dropDuplicates(["work_id", "area"])
    names = t.topic_names.where(F.col("level") == 2).select(F.col("topic").alias("area"), "name")
    return finish(D.disruption_interval(d.join(names, "area", "left")), floats=("mean", "p10", "p90"))


@query("disruption_histogram", oracle=with_views("""
SELECT bin, count(*) AS count, round(-1 + bin * 0.2E0, 6) AS bin_start, round(-1 + (bin + 1) * 0.2E0, 6) AS bin_end
FROM (SELECT CAST(least(floor((cd_score + 1) / 0.2E0), 9) AS INT) AS bin FROM cd_scores) b GROUP BY bin""",
    "cd_scores"))
def q_disruption_histogram(spark, sf):
    return D.disruption_histogram(tables(spark, sf).cd_scores)


@query("highly_cited_scatter", oracle=_dis("""
SELECT DISTINCT work_id, round(cd_score, 6) AS cd_score, cited_by_count, year FROM dd WHERE cited_by_count > 50"""))
def q_highly_cited_scatter(spark, sf):
    d = QI._dis_docs(spark, sf).select("work_id", "cd_score", "cited_by_count", "year").distinct()
    return finish(D.highly_cited_scatter(d), floats=("cd_score",))


@query("histogram_bin_examples", oracle=with_views("""
SELECT c.work_id, w.display_name, row_number() OVER (ORDER BY c.work_id) AS rank
FROM (SELECT work_id FROM cd_scores WHERE cd_score BETWEEN 0.2 AND 0.4 ORDER BY work_id LIMIT 5) c
LEFT JOIN works w ON c.work_id = w.work_id""", "cd_scores", "works"))
def q_histogram_bin_examples(spark, sf):
    t = tables(spark, sf)
    return D.histogram_bin_examples(t.cd_scores, t.works.select("work_id", "display_name"), 0.2, 0.4)


# -- search -------------------------------------------------------------------------
def _search(spark, sf, entities, mode):
    t = tables(spark, sf)
    idx = E.entity_document_index(t.doc_entities, 80, 10)
    scores = QI._doc_novelty(spark, sf, 3)
    out = D.search_documents(idx, t.works.select("work_id", "display_name"), scores, entities, mode, 10)
    return finish(out, floats=("novelty",))


def _search_oracle(where: str) -> str:
    ex = _oracle_ctes(3, "openalex")
    ex["idx"] = """SELECT DISTINCT k.entity, k.doc_id AS document FROM doc_entities k JOIN (
      SELECT entity FROM doc_entities WHERE confidence >= 80 GROUP BY entity HAVING count(*) >= 10) f
      ON k.entity = f.entity WHERE k.confidence >= 80"""
    return with_views(f"""
SELECT h.work_id, round(d.novelty, 6) AS novelty, w.display_name
FROM ({where}) h JOIN dnov d ON h.work_id = d.work_id LEFT JOIN works w ON h.work_id = w.work_id
ORDER BY round(d.novelty, 6) DESC, h.work_id LIMIT 10""", "doc_topics", "docs", "doc_entities", "works", extra=ex)


@query("search_documents_all", oracle=_search_oracle("""
SELECT document AS work_id FROM idx WHERE entity IN ('e10', 'e1009', 'nope')
GROUP BY document HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM idx WHERE entity IN ('e10', 'e1009', 'nope'))"""))
def q_search_documents_all(spark, sf):
    return _search(spark, sf, ["e10", "e1009", "nope"], "all")


@query("search_documents_any", oracle=_search_oracle(
    "SELECT DISTINCT document AS work_id FROM idx WHERE entity IN ('e10', 'e11', 'e12', 'nope')"))
def q_search_documents_any(spark, sf):
    return _search(spark, sf, ["e10", "e11", "e12", "nope"], "any")


@query("ranked_novelty_articles", oracle=_nov(f"""
SELECT g.document_link, g.document_year, w.display_name, round(g.novelty, 6) AS novelty, g.names FROM (
  SELECT document_link, document_year, novelty, string_agg(DISTINCT name, ',' ORDER BY name) AS names,
    bool_or(name = 'Name 1_2') AS has_topic
  FROM (SELECT DISTINCT d.work_id AS document_link, d.year AS document_year, d.area, n.name, d.novelty
        FROM (SELECT work_id, year, novelty, {QI.EXP} FROM nl WHERE level = 3) d
        LEFT JOIN (SELECT DISTINCT area, name FROM ({_lv_sql('nt', NOV_MEASURES)}) v) n ON d.area = n.area
        WHERE d.year BETWEEN {YEARS[0]} AND {YEARS[1]}) x
  GROUP BY document_link, document_year, novelty) g
LEFT JOIN works w ON g.document_link = w.work_id WHERE g.has_topic"""))
def q_ranked_novelty_articles(spark, sf):
    t = tables(spark, sf)
    v = D.level_view(_nov_trends(spark, sf), "area", YEARS, NOV_MEASURES)
    docs = D.level_docs(I.novelty_documents(QI._nov_long(spark, sf)), v, "area", YEARS, "novelty")
    out = D.ranked_novelty_articles(docs, t.works.select("work_id", "display_name"), "Name 1_2")
    return finish(out, floats=("novelty",), lists=("names",))


NOV_DOCS = f"""SELECT DISTINCT d.work_id AS document_link, d.year AS document_year, d.area, n.name, round(d.novelty, 6) AS novelty
FROM (SELECT work_id, year, novelty, {QI.EXP} FROM nl WHERE level = 3) d
LEFT JOIN (SELECT DISTINCT area, name FROM ({_lv_sql('nt', NOV_MEASURES)}) v) n ON d.area = n.area
WHERE d.year BETWEEN {YEARS[0]} AND {YEARS[1]}"""
DIS_DOCS = f"""SELECT DISTINCT d.work_id AS document_link, d.year AS document_year, d.area, n.name, round(d.cd_score, 6) AS cd_score
FROM dd d LEFT JOIN (SELECT DISTINCT area, name FROM ({_lv_sql('dt', DIS_MEASURES)}) v) n ON d.area = n.area
WHERE d.year BETWEEN {YEARS[0]} AND {YEARS[1]}"""


def _novelty_docs(spark, sf):
    v = D.level_view(_nov_trends(spark, sf), "area", YEARS, NOV_MEASURES)
    return D.level_docs(I.novelty_documents(QI._nov_long(spark, sf)), v, "area", YEARS, "novelty")


def _disruption_docs(spark, sf):
    v = D.level_view(_dis_table(spark, sf), "area", YEARS, DIS_MEASURES)
    return D.level_docs(QI._dis_docs(spark, sf), v, "area", YEARS, "cd_score")


@query("disruption_by_level_docs", oracle=_dis(DIS_DOCS))
def q_disruption_by_level_docs(spark, sf):
    return finish(_disruption_docs(spark, sf), floats=("cd_score",))


@query("novelty_weighted_docs", oracle=_nov(f"SELECT * FROM ({NOV_DOCS}) x WHERE document_year BETWEEN {YEARS[0] + 1} AND {YEARS[1]}"))
def q_novelty_weighted_docs(spark, sf):
    return finish(D.sorted_docs(_novelty_docs(spark, sf), (YEARS[0] + 1, YEARS[1]), "novelty"), floats=("novelty",))


@query("disruption_weighted_docs", oracle=_dis(f"SELECT * FROM ({DIS_DOCS}) x WHERE document_year BETWEEN {YEARS[0] + 1} AND {YEARS[1]}"))
def q_disruption_weighted_docs(spark, sf):
    return finish(D.sorted_docs(_disruption_docs(spark, sf), (YEARS[0] + 1, YEARS[1]), "cd_score"), floats=("cd_score",))


@query("ranked_novelty_extremes", oracle=_nov(f"""
SELECT side, rank, document_link, novelty FROM (
  SELECT 'most' AS side, document_link, novelty, row_number() OVER (ORDER BY novelty DESC, document_link) AS rank FROM g UNION ALL
  SELECT 'least', document_link, novelty, row_number() OVER (ORDER BY novelty, document_link) FROM g) r WHERE rank <= 50""",
    extra={"g": f"SELECT DISTINCT document_link, novelty FROM ({NOV_DOCS}) x WHERE name = 'Name 1_2'"}))
def q_ranked_novelty_extremes(spark, sf):
    """The 50 most and the 50 least novel documents of a topic."""
    t = tables(spark, sf)
    ranked = D.ranked_novelty_articles(_novelty_docs(spark, sf), t.works.select("work_id", "display_name"), "Name 1_2")
    ranked = finish(ranked, floats=("novelty",))
    return D.extremes(ranked, "novelty", 50).select("side", "rank", "document_link", "novelty")


@query("unique_words", oracle=with_views(
    "SELECT DISTINCT unnest(string_split(display_name, ' ')) AS word FROM works", "works"))
def q_unique_words(spark, sf):
    return D.unique_words(tables(spark, sf).works, "display_name")


# -- organisations ------------------------------------------------------------------
@query("quad_by_org", oracle=QI._org_oracle("""
SELECT affiliation_string, CAST(sum(volume) AS BIGINT) AS volume, round(avg(average_cd_score), 6) AS average_cd_score
FROM (SELECT o.org AS affiliation_string, o.topic, s.year, count(s.id) AS volume, avg(s.cd_score) AS average_cd_score
      FROM scores s LEFT JOIN orgrows o ON s.id = o.id GROUP BY o.org, o.topic, s.year) x
WHERE affiliation_string IS NOT NULL AND volume IS NOT NULL AND average_cd_score IS NOT NULL
GROUP BY affiliation_string"""))
def q_quad_by_org(spark, sf):
    t = tables(spark, sf)
    quad = I.org_quad(QI._scores(spark, sf), QI._org_rows(spark, sf), t.topic_names)
    return finish(D.quad_by_org(quad, "average_cd_score"), floats=("average_cd_score",))


def _network(spark, sf, edges=True):
    rows = I.expand_topic(QI._org_rows(spark, sf))
    nodes = I.docs_per_org(rows)
    edges = I.collaboration_edges(rows.where(F.col("area") == AREA_ID), by="area") if edges else None
    return D.network_by_topic(rows, nodes, edges, "area", AREA_ID)


_NET = f"""SELECT DISTINCT org FROM orgrows WHERE split_part(topic, '_', 1) || '_' || split_part(topic, '_', 2) = '{AREA_ID}'"""


@query("network_by_topic", oracle=QI._org_oracle(f"""
SELECT a.org AS org_1, b.org AS org_2, count(*) AS weight
FROM (SELECT DISTINCT id, {QI.EXP}, org FROM orgrows) a JOIN (SELECT DISTINCT id, {QI.EXP}, org FROM orgrows) b
  ON a.id = b.id AND a.area = b.area AND a.org < b.org
WHERE a.area = '{AREA_ID}' AND a.org IN ({_NET}) AND b.org IN ({_NET})
GROUP BY a.org, b.org"""))
def q_network_by_topic(spark, sf):
    return _network(spark, sf)[1]


@query("network_by_topic_nodes", oracle=QI._org_oracle(f"""
SELECT org, count(*) AS n_docs, round(ln(count(*)), 6) AS size FROM (SELECT DISTINCT id, org FROM orgrows) u
WHERE org IN ({_NET}) GROUP BY org"""))
def q_network_by_topic_nodes(spark, sf):
    return finish(_network(spark, sf, edges=False)[0], floats=("size",))
