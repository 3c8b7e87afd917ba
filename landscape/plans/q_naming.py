"""Registered topic-naming queries (2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import naming as NM
from .registry import finish, query, tables
from .sqlhelp import top_names
from .views_sql import with_views

JE = """SELECT w.venue_display_name AS journal, k.entity FROM doc_entities k JOIN works w ON k.doc_id = w.work_id
WHERE k.confidence >= 80 AND w.venue_display_name IS NOT NULL"""
BASE = {
    "je": JE,
    "ecount": "SELECT entity, count(*) AS count FROM je GROUP BY entity",
    "jec": """SELECT journal, entity, count(*) AS count FROM je GROUP BY journal, entity""",
    "jes": """SELECT j.journal, j.entity, j.count, j.count / t.n AS share FROM jec j
              JOIN (SELECT journal, sum(count) AS n FROM jec GROUP BY journal) t ON j.journal = t.journal""",
}


def _lec(level: int) -> str:
    return f"SELECT t.Level_{level} AS topic, c.entity, c.count FROM ecount c JOIN taxonomy t ON c.entity = t.entity"


def _ranks(level: int) -> str:
    return f"""
SELECT l.topic, s.journal,
  sum(pow(ln(2 + l.count / n.n), 2) * pow(ln(1 + cj.cj / n.n), 2) * s.share) AS rank
FROM ({_lec(level)}) l
JOIN (SELECT topic, sum(count) AS n FROM ({_lec(level)}) x GROUP BY topic) n ON l.topic = n.topic
JOIN jes s ON s.entity = l.entity
JOIN (SELECT t.Level_{level} AS topic, s.journal, sum(s.count) AS cj FROM jes s JOIN taxonomy t ON s.entity = t.entity
      GROUP BY t.Level_{level}, s.journal) cj ON cj.topic = l.topic AND cj.journal = s.journal
GROUP BY l.topic, s.journal"""


def _o(body: str, extra=None) -> str:
    ex = dict(BASE)
    ex.update(extra or {})
    return with_views(body, "doc_entities", "works", "taxonomy", "topic_names", extra=ex)


def _je(spark, sf):
    """(journal, entity) mentions, staged: every naming statistic starts here."""
    t = tables(spark, sf)
    return t.stage("journal_entities", lambda: NM.journal_entities(t.works, E.entities_kept(t.doc_entities)))


@query("journal_entities", oracle=_o("SELECT journal, entity FROM je"))
def q_journal_entities(spark, sf):
    return _je(spark, sf)


@query("entity_counts", oracle=_o("SELECT entity, count FROM ecount"))
def q_entity_counts(spark, sf):
    return NM.entity_counts(_je(spark, sf))


@query("level_entity_counts", oracle=_o(_lec(2)))
def q_level_entity_counts(spark, sf):
    return NM.level_entity_counts(_je(spark, sf), tables(spark, sf).taxonomy, 2)


@query("journal_entity_counts", oracle=_o("SELECT journal, entity, count, round(share, 6) AS share FROM jes"))
def q_journal_entity_counts(spark, sf):
    return finish(NM.journal_entity_counts(_je(spark, sf)), floats=("share",))


@query("cluster_journal_counts", oracle=_o("""
SELECT t.Level_1 AS topic, s.journal, CAST(sum(s.count) AS BIGINT) AS count FROM jec s JOIN taxonomy t ON s.entity = t.entity
GROUP BY t.Level_1, s.journal"""))
def q_cluster_journal_counts(spark, sf):
    return NM.cluster_journal_counts(_je(spark, sf), tables(spark, sf).taxonomy, 1)


@query("cluster_entity_journal_counts", oracle=_o("""
SELECT t.Level_2 AS topic, s.entity, s.journal, s.count FROM jec s JOIN taxonomy t ON s.entity = t.entity"""))
def q_cluster_entity_journal_counts(spark, sf):
    return NM.cluster_entity_journal_counts(_je(spark, sf), tables(spark, sf).taxonomy, 2)


@query("topic_entity_names", oracle=_o(top_names(
    "lec", "topic", "entity", "count", 10, label="entity || ' (' || CAST(count AS STRING) || ' times)'"),
    extra={"lec": _lec(2)}))
def q_topic_entity_names(spark, sf):
    lec = NM.level_entity_counts(_je(spark, sf), tables(spark, sf).taxonomy, 2)
    return NM.topic_entity_names(lec, 10, show_count=True)


@query("cluster_journal_ranks", oracle=_o("SELECT topic, journal, round(rank, 6) AS rank FROM r", extra={"r": _ranks(1)}))
def q_cluster_journal_ranks(spark, sf):
    return finish(NM.cluster_journal_ranks(_je(spark, sf), tables(spark, sf).taxonomy, 1), floats=("rank",))


@query("topic_journal_names", oracle=_o(top_names("r", "topic", "journal", "rank", 3, prefix="Journals: "),
                                        extra={"r": _ranks(2)}))
def q_topic_journal_names(spark, sf):
    return NM.topic_journal_names(NM.cluster_journal_ranks(_je(spark, sf), tables(spark, sf).taxonomy, 2))


MAIN = """SELECT entity, journal AS main_journal FROM (
  SELECT entity, journal, row_number() OVER (PARTITION BY entity ORDER BY count DESC, journal) AS rn FROM jec) x WHERE rn = 1"""


@query("main_journal", oracle=_o(MAIN))
def q_main_journal(spark, sf):
    return NM.main_journal(_je(spark, sf))


def _named_tax_sql(levels: int = 3) -> tuple[str, dict]:
    extra = {"mainj": MAIN}
    cols, joins = [], []
    for lv in range(1, levels + 1):
        extra[f"lec{lv}"] = _lec(lv)
        extra[f"en{lv}"] = top_names(f"lec{lv}", "topic", "entity", "count", 2)
        extra[f"r{lv}"] = _ranks(lv)
        extra[f"jn{lv}"] = top_names(f"r{lv}", "topic", "journal", "rank", 3, prefix="Journals: ")
        cols += [f"CASE WHEN en{lv}.names IN ('', 'Journals: ') THEN 'Other' ELSE en{lv}.names END AS Level_{lv}_Entity_Names",
                 f"CASE WHEN jn{lv}.names IN ('', 'Journals: ') THEN 'Other' ELSE jn{lv}.names END AS Level_{lv}_Journal_Names"]
        joins += [f"LEFT JOIN en{lv} ON en{lv}.topic = t.Level_{lv}", f"LEFT JOIN jn{lv} ON jn{lv}.topic = t.Level_{lv}"]
    body = f"""
SELECT t.entity, t.Level_1, t.Level_2, t.Level_3, t.Level_4, t.Level_5, {', '.join(cols)},
  coalesce(m.main_journal, 'Other') AS Main_Journal,
  CASE WHEN coalesce(c.count, 0) = 0 THEN 1 ELSE c.count END AS Entity_Count,
  coalesce(nj.n, 0) AS Journal_Count
FROM taxonomy t {' '.join(joins)}
LEFT JOIN mainj m ON m.entity = t.entity LEFT JOIN ecount c ON c.entity = t.entity
LEFT JOIN (SELECT entity, count(DISTINCT journal) AS n FROM je GROUP BY entity) nj ON nj.entity = t.entity"""
    return body, extra


_NT_BODY, _NT_EXTRA = _named_tax_sql(3)


@query("named_taxonomy", oracle=_o(_NT_BODY, extra=_NT_EXTRA))
def q_named_taxonomy(spark, sf):
    return NM.named_taxonomy(tables(spark, sf).taxonomy, _je(spark, sf), 3)


def _entity_name_rows(spark, sf, levels=(1, 2, 3), n=3):
    t = tables(spark, sf)
    je = _je(spark, sf)
    parts = [NM.topic_entity_names(NM.level_entity_counts(je, t.taxonomy, lv), n)
             .select(F.lit(lv).alias("level"), "topic", F.col("names").alias("name")) for lv in levels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_NEW_NAMES = " UNION ALL ".join(
    f"SELECT {lv} AS level, topic, names AS name FROM ({top_names(f'lec{lv}', 'topic', 'entity', 'count', 3)}) x{lv}"
    for lv in (1, 2, 3))


@query("merge_topic_names", oracle=_o("""
SELECT level, topic, name FROM (
  SELECT *, row_number() OVER (PARTITION BY level, topic ORDER BY p) AS rn FROM (
    SELECT level, topic, name, 0 AS p FROM topic_names UNION ALL SELECT level, topic, name, 1 FROM nn) u) x WHERE rn = 1""",
    extra={**{f"lec{lv}": _lec(lv) for lv in (1, 2, 3)}, "nn": _NEW_NAMES}))
def q_merge_topic_names(spark, sf):
    return NM.merge_topic_names(_entity_name_rows(spark, sf), tables(spark, sf).topic_names)


@query("taxonomy_with_names", oracle=_o("""
SELECT t.*, n1.names AS Level_1_Entity_Names, n2.names AS Level_2_Entity_Names, n3.names AS Level_3_Entity_Names
FROM taxonomy t LEFT JOIN en1 n1 ON n1.topic = t.Level_1 LEFT JOIN en2 n2 ON n2.topic = t.Level_2
LEFT JOIN en3 n3 ON n3.topic = t.Level_3""", extra={
    **{f"lec{lv}": _lec(lv) for lv in (1, 2, 3)},
    **{f"en{lv}": top_names(f"lec{lv}", "topic", "entity", "count", 3) for lv in (1, 2, 3)}}))
def q_taxonomy_with_names(spark, sf):
    t = tables(spark, sf)
    je = _je(spark, sf)
    names = {lv: NM.topic_entity_names(NM.level_entity_counts(je, t.taxonomy, lv), 3) for lv in (1, 2, 3)}
    return NM.taxonomy_with_names(t.taxonomy, names)


@query("pending_topics", oracle=_o("""
SELECT level, topic, row_number() OVER (ORDER BY level, topic) AS rn,
  CAST(floor((row_number() OVER (ORDER BY level, topic) - 1) / 6) AS BIGINT) AS batch
FROM (SELECT DISTINCT level, topic FROM (
  SELECT 1 AS level, Level_1 AS topic FROM taxonomy UNION ALL SELECT 2, Level_2 FROM taxonomy UNION ALL
  SELECT 3, Level_3 FROM taxonomy UNION ALL SELECT 4, Level_4 FROM taxonomy UNION ALL SELECT 5, Level_5 FROM taxonomy) a
  WHERE NOT EXISTS (SELECT 1 FROM topic_names n WHERE n.level = a.level AND n.topic = a.topic)) p"""))
def q_pending_topics(spark, sf):
    t = tables(spark, sf)
    return NM.pending_topics(t.taxonomy, t.topic_names, levels=(1, 2, 3, 4, 5))


@query("duplicate_topic_names", oracle=_o("""
SELECT n.level, n.topic, n.name, e.names AS entities FROM (
  SELECT *, count(*) OVER (PARTITION BY level, name) AS k FROM nn) n
LEFT JOIN en4 e ON e.topic = n.topic WHERE n.k > 1""", extra={
    "lec4": _lec(4),
    "nn": "SELECT DISTINCT 4 AS level, Level_4 AS topic, 'Name ' || Level_3 AS name FROM taxonomy",
    "en4": top_names("lec4", "topic", "entity", "count", 10)}))
def q_duplicate_topic_names(spark, sf):
    # level-4 topics named after their parent: siblings share a name
    t = tables(spark, sf)
    lec = NM.level_entity_counts(_je(spark, sf), t.taxonomy, 4)
    names = t.taxonomy.select(F.lit(4).alias("level"), F.col("Level_4").alias("topic"),
                              F.concat(F.lit("Name "), F.col("Level_3")).alias("name")).distinct()
    return NM.duplicate_topic_names(names, lec, 10)


@query("top_entities_table", oracle=_o("""
SELECT e.topic, e.names, n.level, n.name FROM en2 e JOIN topic_names n ON e.topic = n.topic""",
    extra={"lec2": _lec(2), "en2": top_names("lec2", "topic", "entity", "count", 10)}))
def q_top_entities_table(spark, sf):
    t = tables(spark, sf)
    lec = NM.level_entity_counts(_je(spark, sf), t.taxonomy, 2)
    return NM.top_entities_table(NM.topic_entity_names(lec, 10), t.topic_names)


@query("entity_journal_counts", oracle=_o("SELECT entity, journal, count, round(share, 6) AS share FROM jes"))
def q_entity_journal_counts(spark, sf):
    """Entity -> journal view of the same counts: absolute and as a share of
    the journal's mentions."""
    c = NM.journal_entity_counts(_je(spark, sf)).select("entity", "journal", "count", "share")
    return finish(c, floats=("share",))
