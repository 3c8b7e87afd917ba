"""Registered queries for the indicator tables (2.E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import indicators as I
from ..operators import naming as NM
from ..operators import novelty as N
from .q_novelty import _oracle_ctes
from .registry import finish, query, tables
from .sqlhelp import nearest_quartiles, top_names, unit_hash
from .views_sql import with_views

QUART = ["25", "50", "75", "_mean"]


from .q_novelty import _topics  # noqa: E402,F401


def _doc_novelty(spark, sf, level=3):
    t = tables(spark, sf)

    def build():
        return N.document_novelty(N.novelty_input(_topics(spark, sf), t.docs, level))
    return t.stage(f"doc_novelty_{level}", build)


def _top_entities(spark, sf, n=5):
    """(topic, entities): top-n entity names of topics at levels 1-3 (staged)."""
    t = tables(spark, sf)

    def build():
        je = NM.journal_entities(t.works, E.entities_kept(t.doc_entities))
        parts = [NM.topic_entity_names(NM.level_entity_counts(je, t.taxonomy, lvl), n) for lvl in (1, 2, 3)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumnRenamed("names", "entities")
    return t.stage(f"top_entities_{n}", build)


# -- shared oracle CTEs ----------------------------------------------------
T3 = "SELECT doc_id AS id, topic FROM doc_topics WHERE level = 3 AND source = 'openalex'"
EXP = "split_part(topic, '_', 1) AS domain, split_part(topic, '_', 1) || '_' || split_part(topic, '_', 2) AS area"
JE = """SELECT w.venue_display_name AS journal, k.entity FROM doc_entities k JOIN works w ON k.doc_id = w.work_id
WHERE k.confidence >= 80 AND w.venue_display_name IS NOT NULL"""
ECOUNT = "SELECT entity, count(*) AS cnt FROM je GROUP BY entity"


def _lec(level: int) -> str:
    return f"SELECT t.Level_{level} AS topic, c.entity, c.cnt FROM ecount c JOIN taxonomy t ON c.entity = t.entity"


TOPENT = {
    "je": JE, "ecount": ECOUNT,
    "lec_all": " UNION ALL ".join(f"SELECT * FROM ({_lec(i)}) l{i}" for i in (1, 2, 3)),
    "topent": top_names("lec_all", "topic", "entity", "cnt", 5),
}
NAMES = "SELECT topic, name FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY level) AS rn FROM topic_names) x WHERE rn = 1"


def _names3(alias_cols: bool = True) -> str:
    return """
LEFT JOIN (SELECT topic AS n_domain, name AS domain_name FROM topic_names WHERE level = 1) nd ON nd.n_domain = x.domain
LEFT JOIN (SELECT topic AS n_area, name AS area_name FROM topic_names WHERE level = 2) na ON na.n_area = x.area
LEFT JOIN (SELECT topic AS n_topic, name AS topic_name FROM topic_names WHERE level = 3) nt ON nt.n_topic = x.topic"""


@query("expand_topic", oracle=with_views(f"SELECT DISTINCT topic, {EXP} FROM doc_topics WHERE level = 3", "doc_topics"))
def q_expand_topic(spark, sf):
    return I.expand_topic(_topics(spark, sf).where(F.col("level") == 3).select("topic").distinct())


@query("add_topic_names", oracle=with_views(f"""
SELECT x.topic, x.domain, x.area, domain_name, area_name, topic_name
FROM (SELECT DISTINCT topic, {EXP} FROM doc_topics WHERE level = 3) x {_names3()}""", "doc_topics", "topic_names"))
def q_add_topic_names(spark, sf):
    t = tables(spark, sf)
    x = I.expand_topic(_topics(spark, sf).where(F.col("level") == 3).select("topic").distinct())
    return I.add_topic_names(x, t.topic_names)


@query("names_first_level_wins", oracle=with_views(NAMES, "topic_names"))
def q_names_first_level_wins(spark, sf):
    return I.names_first_level_wins(tables(spark, sf).topic_names)


@query("count_documents", oracle=with_views("""
SELECT t.topic, w.year, count(*) AS count
FROM (SELECT doc_id AS id, topic FROM doc_topics WHERE level = 3 AND source = 'openalex') t
LEFT JOIN (SELECT doc_id, year FROM docs) w ON t.id = w.doc_id GROUP BY t.topic, w.year""", "doc_topics", "docs"))
def q_count_documents(spark, sf):
    t = tables(spark, sf)
    d = I.docs_with_topics(_topics(spark, sf), 3, "openalex")
    return I.count_documents(d.join(t.docs.select(F.col("doc_id").alias("id"), "year"), "id", "left"))


VOLUME_SQL = f"""
SELECT x.topic, x.year, x.publication_count, x.patent_count, x.domain, x.area, x.total_docs,
  domain_name, area_name, topic_name
FROM (SELECT coalesce(w.topic, p.topic) AS topic, coalesce(w.year, p.year) AS year,
        coalesce(w.c, 0) AS publication_count, coalesce(p.c, 0) AS patent_count,
        split_part(coalesce(w.topic, p.topic), '_', 1) AS domain,
        split_part(coalesce(w.topic, p.topic), '_', 1) || '_' || split_part(coalesce(w.topic, p.topic), '_', 2) AS area,
        coalesce(w.c, 0) + coalesce(p.c, 0) AS total_docs
      FROM wc w FULL OUTER JOIN pc p ON w.topic = p.topic AND w.year IS NOT DISTINCT FROM p.year) x
{_names3()}"""
VOLUME_CTES = {
    "wc": """SELECT t.topic, d.year, count(*) AS c FROM doc_topics t LEFT JOIN docs d ON t.doc_id = d.doc_id
             WHERE t.level = 3 AND t.source = 'openalex' GROUP BY t.topic, d.year""",
    "pc": """SELECT t.topic, d.year, count(*) AS c FROM doc_topics t LEFT JOIN docs d ON t.doc_id = d.doc_id
             WHERE t.level = 3 AND t.source = 'patents' GROUP BY t.topic, d.year"""}


@query("volume_table", oracle=with_views(VOLUME_SQL, "doc_topics", "docs", "topic_names", extra=VOLUME_CTES))
def q_volume_table(spark, sf):
    t = tables(spark, sf)
    return I.volume_table(_topics(spark, sf), t.docs, t.topic_names)


@query("cd_index", oracle=with_views("""
SELECT focal AS work_id,
  CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS n_only_focal,
  CAST(count(*) FILTER (WHERE a AND b) AS BIGINT) AS n_both,
  CAST(count(*) FILTER (WHERE b AND NOT a) AS BIGINT) AS n_only_refs,
  round((count(*) FILTER (WHERE a AND NOT b) - count(*) FILTER (WHERE a AND b)) / count(*), 6) AS cd_score
FROM (
  SELECT coalesce(d.focal, v.focal) AS focal, d.focal IS NOT NULL AS a, v.focal IS NOT NULL AS b
  FROM (SELECT DISTINCT cited AS focal, citing AS citer FROM citations) d
  FULL OUTER JOIN (SELECT DISTINCT r.citing AS focal, c.citing AS citer
                   FROM citations r JOIN citations c ON r.cited = c.cited WHERE c.citing <> r.citing) v
  ON d.focal = v.focal AND d.citer = v.citer) x
GROUP BY focal""", "citations"))
def q_cd_index(spark, sf):
    return finish(I.cd_index(tables(spark, sf).citations), floats=("cd_score",))


def _dis_docs(spark, sf):
    t = tables(spark, sf)  # read by every disruption table and view
    return t.stage("disruption_documents", lambda: I.disruption_documents(_topics(spark, sf), t.cd_scores, t.works))


DIS = {
    "dd": f"""SELECT x.*, {EXP.replace('topic', 'x.topic')} FROM (
      SELECT t.work_id, t.topic, c.cd_score, c.year, w.cited_by_count
      FROM (SELECT DISTINCT doc_id AS work_id, topic FROM doc_topics WHERE level = 3 AND source = 'openalex') t
      JOIN cd_scores c ON t.work_id = c.work_id LEFT JOIN works w ON t.work_id = w.work_id) x""",
}
for _lv in ("topic", "area", "domain"):
    DIS[f"d_{_lv}"] = f"SELECT DISTINCT work_id, year, {_lv}, cd_score FROM dd"
    DIS[f"q_{_lv}"] = nearest_quartiles(f"d_{_lv}", ["year", _lv], "cd_score", f"{_lv}_cd_score")
    DIS[f"c_{_lv}"] = f"SELECT {_lv}, count(*) AS {_lv}_doc_counts FROM (SELECT DISTINCT work_id, {_lv} FROM dd) u GROUP BY {_lv}"


def _dis_oracle(body: str, *more: str, extra=None) -> str:
    ex = dict(DIS)
    ex.update(extra or {})
    return with_views(body, "doc_topics", "cd_scores", "works", *more, extra=ex)


@query("disruption_documents", oracle=_dis_oracle(
    "SELECT work_id, topic, round(cd_score, 6) AS cd_score, year, cited_by_count, domain, area FROM dd"))
def q_disruption_documents(spark, sf):
    return finish(_dis_docs(spark, sf), floats=("cd_score",))


def _q_cols(lv):
    return ", ".join(f"round({lv}_cd_score{s}, 6) AS {lv}_cd_score{s}" for s in QUART)


for _lv in ("topic", "area", "domain"):
    def _mk(lv):
        @query(f"disruption_by_{lv}", oracle=_dis_oracle(f"SELECT year, {lv}, {_q_cols(lv)} FROM q_{lv}"))
        def _q(spark, sf):
            return finish(I.disruption_by_level(_dis_docs(spark, sf), lv),
                          floats=tuple(f"{lv}_cd_score{s}" for s in QUART))
        return _q
    _mk(_lv)


@query("level_doc_counts", oracle=_dis_oracle("""
SELECT 'topic' AS level, topic AS id, topic_doc_counts AS doc_counts FROM c_topic UNION ALL
SELECT 'area', area, area_doc_counts FROM c_area UNION ALL SELECT 'domain', domain, domain_doc_counts FROM c_domain"""))
def q_level_doc_counts(spark, sf):
    d = _dis_docs(spark, sf)
    parts = [I.level_doc_counts(d, lv).select(F.lit(lv).alias("level"), F.col(lv).alias("id"),
                                              F.col(f"{lv}_doc_counts").alias("doc_counts"))
             for lv in ("topic", "area", "domain")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DT_FLOATS = tuple(f"{lv}_cd_score{s}" for lv in ("topic", "area", "domain") for s in QUART)


DIS_TABLE_SQL = f"""
SELECT r.domain, r.area, r.topic, r.year,
  {', '.join(f'round(q_{lv}.{lv}_cd_score{s}, 6) AS {lv}_cd_score{s}' for lv in ('topic', 'area', 'domain') for s in QUART)},
  nt.name AS topic_name, na.name AS area_name, nd.name AS domain_name,
  et.names AS topic_entities, ea.names AS area_entities, ed.names AS domain_entities,
  c_topic.topic_doc_counts, c_area.area_doc_counts, c_domain.domain_doc_counts
FROM (SELECT DISTINCT domain, area, topic, year FROM dd) r
LEFT JOIN q_topic ON q_topic.year = r.year AND q_topic.topic = r.topic
LEFT JOIN q_area ON q_area.year = r.year AND q_area.area = r.area
LEFT JOIN q_domain ON q_domain.year = r.year AND q_domain.domain = r.domain
LEFT JOIN names nt ON nt.topic = r.topic LEFT JOIN names na ON na.topic = r.area LEFT JOIN names nd ON nd.topic = r.domain
LEFT JOIN topent et ON et.topic = r.topic LEFT JOIN topent ea ON ea.topic = r.area LEFT JOIN topent ed ON ed.topic = r.domain
LEFT JOIN c_topic ON c_topic.topic = r.topic LEFT JOIN c_area ON c_area.area = r.area
LEFT JOIN c_domain ON c_domain.domain = r.domain"""


@query("disruption_table", oracle=_dis_oracle(DIS_TABLE_SQL, "topic_names", "doc_entities", "taxonomy",
    extra={**TOPENT, "names": NAMES}))
def q_disruption_table(spark, sf):
    t = tables(spark, sf)
    return finish(I.disruption_table(_dis_docs(spark, sf), t.topic_names, _top_entities(spark, sf)),
                  floats=_DT_FLOATS)


# -- novelty tables ----------------------------------------------------------
def _nov_long(spark, sf):
    """Novelty of levels 1-3 in one pass (level is a key), staged."""
    t = tables(spark, sf)

    def build():
        nin = t.stage("novelty_in_levels_1_3",
                      lambda: N.novelty_input(_topics(spark, sf), t.docs, (1, 2, 3)))
        # read for the topics' counts and for the rows
        return I.novelty_long(t.stage("doc_novelty_levels_1_3", lambda: N.document_novelty(nin, by=["level"])))
    return t.stage("novelty_long", build)


_NL = {}
for _l in (1, 2, 3):
    _NL.update(_oracle_ctes(_l, "openalex", f"l{_l}_"))
_NL["nl0"] = " UNION ALL ".join(
    f"SELECT DISTINCT {l} AS level, d.work_id, d.year, d.novelty, t.topic FROM l{l}_dnov d JOIN l{l}_ntop t ON d.work_id = t.work_id"
    for l in (1, 2, 3))
_NL["nl"] = "SELECT n.*, c.doc_counts FROM nl0 n JOIN (SELECT level, topic, count(*) AS doc_counts FROM nl0 GROUP BY level, topic) c ON n.level = c.level AND n.topic = c.topic"


def _nl_oracle(body: str, *more, extra=None) -> str:
    ex = dict(_NL)
    ex.update(extra or {})
    return with_views(body, "doc_topics", "docs", *more, extra=ex)


@query("novelty_long", oracle=_nl_oracle(
    "SELECT level, topic, work_id, year, round(novelty, 6) AS novelty, doc_counts FROM nl"))
def q_novelty_long(spark, sf):
    return finish(_nov_long(spark, sf), floats=("novelty",))


@query("novelty_documents", oracle=_nl_oracle(
    f"SELECT work_id, year, round(novelty, 6) AS novelty, {EXP}, topic FROM nl WHERE level = 3"))
def q_novelty_documents(spark, sf):
    return finish(I.novelty_documents(_nov_long(spark, sf)), floats=("novelty",))


@query("document_names", oracle=_nl_oracle(
    "SELECT DISTINCT w.work_id, w.display_name FROM works w JOIN nl ON nl.work_id = w.work_id WHERE nl.level = 3",
    "works"))
def q_document_names(spark, sf):
    t = tables(spark, sf)
    return I.document_names(t.works, I.novelty_documents(_nov_long(spark, sf)))


_NT = {"nq": nearest_quartiles("nl", ["level", "topic", "year"], "novelty", "novelty"),
       "nqc": "SELECT q.*, c.doc_counts FROM nq q JOIN (SELECT DISTINCT level, topic, doc_counts FROM nl) c ON q.level = c.level AND q.topic = c.topic"}
_NT_COLS = [f"novelty{s}" for s in QUART]


NOV_TRENDS_SQL = f"""
SELECT x.topic, x.year, {', '.join(f'round(x.{c}, 6) AS topic_{c}' for c in _NT_COLS)}, x.doc_counts AS topic_doc_counts,
  x.domain, x.area,
  {', '.join(f'round(a.{c}, 6) AS area_{c}' for c in _NT_COLS)}, a.doc_counts AS area_doc_counts,
  {', '.join(f'round(d.{c}, 6) AS domain_{c}' for c in _NT_COLS)}, d.doc_counts AS domain_doc_counts,
  nt.name AS topic_name, et.names AS topic_entities, na.name AS area_name, ea.names AS area_entities,
  nd.name AS domain_name, ed.names AS domain_entities
FROM (SELECT *, {EXP} FROM nqc WHERE level = 3) x
LEFT JOIN (SELECT * FROM nqc WHERE level = 2) a ON a.topic = x.area AND a.year = x.year
LEFT JOIN (SELECT * FROM nqc WHERE level = 1) d ON d.topic = x.domain AND d.year = x.year
LEFT JOIN names nt ON nt.topic = x.topic LEFT JOIN names na ON na.topic = x.area LEFT JOIN names nd ON nd.topic = x.domain
LEFT JOIN topent et ON et.topic = x.topic LEFT JOIN topent ea ON ea.topic = x.area LEFT JOIN topent ed ON ed.topic = x.domain"""


@query("novelty_trends", oracle=_nl_oracle(NOV_TRENDS_SQL,
    "topic_names", "doc_entities", "taxonomy", "works", extra={**_NT, **TOPENT, "names": NAMES}))
def q_novelty_trends(spark, sf):
    t = tables(spark, sf)
    out = I.novelty_trends(_nov_long(spark, sf), t.topic_names, _top_entities(spark, sf))
    return finish(out, floats=tuple(f"{p}_{c}" for p in ("topic", "area", "domain") for c in _NT_COLS))


# -- organisations -----------------------------------------------------------
SCORES = """SELECT coalesce(c.work_id, d.work_id) AS id, c.cd_score, d.novelty, coalesce(c.year, d.year) AS year
FROM cd_scores c FULL OUTER JOIN dnov d ON c.work_id = d.work_id"""
ORGROWS = f"""SELECT t.id, t.topic, o.org FROM ({T3}) t JOIN (SELECT doc_id, org FROM doc_orgs WHERE org IS NOT NULL) o
ON t.id = o.doc_id"""


def _scores(spark, sf):
    return I.scores_combined(tables(spark, sf).cd_scores, _doc_novelty(spark, sf, 3))


def _org_rows(spark, sf):
    return I.publication_org_rows(_topics(spark, sf), tables(spark, sf).doc_orgs)


def _org_oracle(body: str, *more, extra=None) -> str:
    ex = _oracle_ctes(3, "openalex")
    ex.update({"scores": SCORES, "orgrows": ORGROWS})
    ex.update(extra or {})
    return with_views(body, "doc_topics", "docs", "cd_scores", "doc_orgs", *more, extra=ex)


@query("scores_combined", oracle=_org_oracle(
    "SELECT id, round(cd_score, 6) AS cd_score, round(novelty, 6) AS novelty, year FROM scores"))
def q_scores_combined(spark, sf):
    return finish(_scores(spark, sf), floats=("cd_score", "novelty"))


@query("publication_org_rows", oracle=_org_oracle("SELECT id, topic, org FROM orgrows"))
def q_publication_org_rows(spark, sf):
    return _org_rows(spark, sf)


@query("org_quad", oracle=_org_oracle(f"""
SELECT x.affiliation_string, x.year, x.volume, round(x.average_cd_score, 6) AS average_cd_score,
  round(x.average_novelty_score, 6) AS average_novelty_score, domain_name, area_name, topic_name
FROM (SELECT o.org AS affiliation_string, o.topic, s.year, count(s.id) AS volume, avg(s.cd_score) AS average_cd_score,
        avg(s.novelty) AS average_novelty_score, {EXP.replace('topic', 'o.topic')}
      FROM scores s LEFT JOIN orgrows o ON s.id = o.id GROUP BY o.org, o.topic, s.year) x {_names3()}""",
    "topic_names"))
def q_org_quad(spark, sf):
    t = tables(spark, sf)
    return finish(I.org_quad(_scores(spark, sf), _org_rows(spark, sf), t.topic_names),
                  floats=("average_cd_score", "average_novelty_score"))


@query("topic_lookup", oracle=with_views(f"""
SELECT x.topic, x.domain, x.area, domain_name, area_name, topic_name
FROM (SELECT DISTINCT topic, {EXP} FROM doc_topics WHERE level = 3 AND source = 'patents') x {_names3()}""",
    "doc_topics", "topic_names"))
def q_topic_lookup(spark, sf):
    return I.topic_lookup(_topics(spark, sf), tables(spark, sf).topic_names, "patents")


def _lookup_oracle(sources: str) -> str:
    return with_views(f"""
SELECT x.topic, x.domain, x.area, domain_name, area_name, topic_name
FROM (SELECT DISTINCT topic, {EXP} FROM doc_topics WHERE level = 3 AND source IN ({sources})) x {_names3()}""",
        "doc_topics", "topic_names")


@query("topic_lookup_works", oracle=_lookup_oracle("'openalex'"))
def q_topic_lookup_works(spark, sf):
    return I.topic_lookup(_topics(spark, sf), tables(spark, sf).topic_names, "openalex")


@query("topic_lookup_both", oracle=_lookup_oracle("'openalex', 'patents'"))
def q_topic_lookup_both(spark, sf):
    t = tables(spark, sf)
    works, patents = (I.topic_lookup(_topics(spark, sf), t.topic_names, s) for s in ("openalex", "patents"))
    return works.unionByName(patents).distinct()


@query("docs_per_org", oracle=_org_oracle(
    "SELECT org, count(*) AS n_docs FROM (SELECT DISTINCT id, org FROM orgrows) u GROUP BY org"))
def q_docs_per_org(spark, sf):
    return I.docs_per_org(_org_rows(spark, sf))


@query("org_topics", oracle=_org_oracle(
    f"SELECT org, domain, count(*) AS n_rows FROM (SELECT org, {EXP} FROM orgrows) u GROUP BY org, domain"))
def q_org_topics(spark, sf):
    return I.org_topics(I.expand_topic(_org_rows(spark, sf)), "domain")


@query("org_topics_by_level", oracle=_org_oracle(" UNION ALL ".join(
    f"SELECT org, '{by}' AS level, {by} AS name, count(*) AS n_rows FROM (SELECT org, topic, {EXP} FROM orgrows) u GROUP BY org, {by}"
    for by in ("domain", "area", "topic"))))
def q_org_topics_by_level(spark, sf):
    return I.org_topics(I.by_topic_level(_org_rows(spark, sf)), ["level", "name"])


@query("collaboration_edges", oracle=_org_oracle("""
SELECT a.org AS org_1, b.org AS org_2, count(*) AS n_docs
FROM (SELECT DISTINCT id, org FROM orgrows) a JOIN (SELECT DISTINCT id, org FROM orgrows) b
  ON a.id = b.id AND a.org < b.org GROUP BY a.org, b.org"""))
def q_collaboration_edges(spark, sf):
    return I.collaboration_edges(_org_rows(spark, sf))


def _by_level_sql(names: dict[str, str]) -> str:
    """Edges of domains, areas and topics, one after the other; the level's columns come from ``names``."""
    return _org_oracle(" UNION ALL ".join(f"""
SELECT '{by}' AS level, {cols}, a.org AS org_1, b.org AS org_2, count(*) AS n_docs, 1 AS present
FROM (SELECT DISTINCT id, {by}, org FROM (SELECT id, topic, {EXP}, org FROM orgrows) u) a
JOIN (SELECT DISTINCT id, {by}, org FROM (SELECT id, topic, {EXP}, org FROM orgrows) u) b
  ON a.id = b.id AND a.{by} = b.{by} AND a.org < b.org GROUP BY a.{by}, a.org, b.org""" for by, cols in names.items()))


_DOMAIN, _AREA = (f"array_to_string(list_slice(string_split({{}}, '_'), 1, {i}), '_')".format for i in (1, 2))


@query("collaboration_edges_by_topic", oracle=_by_level_sql({
    "domain": "a.domain, CAST(NULL AS STRING) AS area, CAST(NULL AS STRING) AS topic",
    "area": f"{_DOMAIN('a.area')} AS domain, a.area, CAST(NULL AS STRING) AS topic",
    "topic": f"{_DOMAIN('a.topic')} AS domain, {_AREA('a.topic')} AS area, a.topic"}))
def q_collaboration_edges_by_topic(spark, sf):
    """Of every domain, area and topic; those below the level are null."""
    e = q_collaboration_edges_by_level(spark, sf)
    e = I.expand_topic(e, "name").withColumn("area", F.when(F.col("level") != "domain", F.col("area")))
    return e.withColumn("topic", F.when(F.col("level") == "topic", F.col("name"))).select(
        "level", "domain", "area", "topic", "org_1", "org_2", "n_docs", "present")


@query("collaboration_edges_by_level", oracle=_by_level_sql({by: f"a.{by} AS name" for by in ("domain", "area", "topic")}))
def q_collaboration_edges_by_level(spark, sf):
    rows = _org_rows(spark, sf)
    return I.collaboration_edges(rows, by="topic", at=I.topic_levels).withColumn("present", F.lit(1))


@query("collaboration_network", oracle=_org_oracle("""
SELECT a.org AS org_1, b.org AS org_2, count(*) AS n_docs
FROM (SELECT DISTINCT id, org FROM orgrows WHERE org IN (SELECT org FROM top)) a
JOIN (SELECT DISTINCT id, org FROM orgrows WHERE org IN (SELECT org FROM top)) b
  ON a.id = b.id AND a.org < b.org GROUP BY a.org, b.org""", extra={
    "top": "SELECT org FROM (SELECT org, count(*) AS n FROM (SELECT DISTINCT id, org FROM orgrows) u GROUP BY org) c ORDER BY n DESC, org LIMIT 50"}))
def q_collaboration_network(spark, sf):
    _nodes, edges = I.collaboration_network(_org_rows(spark, sf), top_n=50)
    return edges


@query("collaboration_nodes", oracle=_org_oracle("""
SELECT org, count(*) AS n_docs FROM (SELECT DISTINCT id, org FROM orgrows) u GROUP BY org ORDER BY n_docs DESC, org LIMIT 50"""))
def q_collaboration_nodes(spark, sf):
    nodes, _edges = I.collaboration_network(_org_rows(spark, sf), top_n=50)
    return nodes


TOP500 = """SELECT org, n_docs FROM (SELECT org, count(*) AS n_docs FROM (SELECT DISTINCT id, org FROM orgrows) u GROUP BY org) c
ORDER BY n_docs DESC, org LIMIT 500"""


@query("collaboration_network_500", oracle=_org_oracle("""
SELECT a.org AS org_1, b.org AS org_2, count(*) AS n_docs
FROM (SELECT DISTINCT id, org FROM orgrows WHERE org IN (SELECT org FROM top)) a
JOIN (SELECT DISTINCT id, org FROM orgrows WHERE org IN (SELECT org FROM top)) b
  ON a.id = b.id AND a.org < b.org GROUP BY a.org, b.org""", extra={"top": TOP500}))
def q_collaboration_network_500(spark, sf):
    _nodes, edges = I.collaboration_network(_org_rows(spark, sf), top_n=500)
    return edges


@query("collaboration_nodes_500", oracle=_org_oracle("SELECT org, n_docs FROM top", extra={"top": TOP500}))
def q_collaboration_nodes_500(spark, sf):
    nodes, _edges = I.collaboration_network(_org_rows(spark, sf), top_n=500)
    return nodes


@query("dashboard_sample", oracle=_nl_oracle(f"""
SELECT n.work_id, n.year, round(n.novelty, 6) AS novelty, n.domain, n.area, n.topic, w.display_name, round(c.cd_score, 6) AS cd_score
FROM (SELECT work_id, year, novelty, {EXP}, topic FROM nl WHERE level = 3) n
LEFT JOIN works w ON w.work_id = n.work_id
LEFT JOIN (SELECT DISTINCT c.work_id, c.cd_score FROM cd_scores c JOIN doc_topics t ON t.doc_id = c.work_id
           WHERE t.level = 3 AND t.source = 'openalex') c ON c.work_id = n.work_id
WHERE {unit_hash('n.work_id', 7)} < 0.1E0""", "works", "cd_scores", "doc_topics"))
def q_dashboard_sample(spark, sf):
    """A 10 % document sample kept consistent across the dashboard tables:
    one seeded hash of the work id decides for names, novelty, disruption and
    the entity index alike (here: the sampled novelty documents with names)."""
    from ..functions.sampling import hash_sample
    t = tables(spark, sf)
    ids = hash_sample(t.works.select("work_id"), "work_id", 0.1, seed=7)
    nov = I.novelty_documents(_nov_long(spark, sf)).join(ids, "work_id", "left_semi")
    dis = _dis_docs(spark, sf).join(ids, "work_id", "left_semi").select("work_id", "cd_score")
    names = t.works.select("work_id", "display_name").join(ids, "work_id", "left_semi")
    out = nov.join(names, "work_id", "left").join(dis.dropDuplicates(["work_id"]), "work_id", "left")
    return finish(out, floats=("novelty", "cd_score"))


_SAMPLED = f"{unit_hash('{}', 7)} < 0.1E0"


def _sample_tables(spark, sf):
    """All four tables of the sample."""
    from ..functions.sampling import hash_sample
    from ..operators.entities import entity_document_index
    t = tables(spark, sf)
    nov = I.novelty_documents(_nov_long(spark, sf))
    return I.dashboard_sample(hash_sample(t.works.select("work_id"), "work_id", 0.1, seed=7), I.document_names(t.works, nov), nov,
                              _dis_docs(spark, sf), entity_document_index(t.doc_entities, 80, 10))


@query("dashboard_sample_names", oracle=_nl_oracle(f"""
SELECT DISTINCT w.work_id, w.display_name FROM works w JOIN nl ON nl.work_id = w.work_id
WHERE nl.level = 3 AND {_SAMPLED.format('w.work_id')}""", "works"))
def q_dashboard_sample_names(spark, sf):
    return _sample_tables(spark, sf)["names"]


@query("dashboard_sample_novelty", oracle=_nl_oracle(f"""
SELECT work_id, year, round(novelty, 6) AS novelty, {EXP}, topic FROM nl WHERE level = 3
  AND work_id IN (SELECT work_id FROM works) AND {_SAMPLED.format('work_id')}""", "works"))
def q_dashboard_sample_novelty(spark, sf):
    return finish(_sample_tables(spark, sf)["novelty"], floats=("novelty",))


@query("dashboard_sample_disruption", oracle=_dis_oracle(f"""
SELECT work_id, topic, round(cd_score, 6) AS cd_score, year, cited_by_count, domain, area FROM dd
WHERE work_id IN (SELECT work_id FROM works) AND {_SAMPLED.format('work_id')}"""))
def q_dashboard_sample_disruption(spark, sf):
    return finish(_sample_tables(spark, sf)["disruption"], floats=("cd_score",))


@query("dashboard_sample_entities", oracle=with_views(f"""
SELECT DISTINCT k.entity, k.doc_id AS document FROM doc_entities k JOIN (
  SELECT entity FROM doc_entities WHERE confidence >= 80 GROUP BY entity HAVING count(*) >= 10) f ON k.entity = f.entity
WHERE k.confidence >= 80 AND k.doc_id IN (SELECT work_id FROM works) AND {_SAMPLED.format('k.doc_id')}""", "doc_entities", "works"))
def q_dashboard_sample_entities(spark, sf):
    return _sample_tables(spark, sf)["entities"]
