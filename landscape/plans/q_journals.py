"""Registered journal x topic statistics (2.L) and roll-ups (2.M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import journals as J
from ..operators import naming as NM
from ..operators import rollups as R
from .q_naming import BASE as NBASE
from .q_naming import _je
from .registry import finish, query, tables
from .sqlhelp import unit_hash
from .views_sql import with_views

EJL = """SELECT j.entity, j.journal, j.count, t.Level_1, t.Level_2, t.Level_3, t.Level_4, t.Level_5
FROM jec j JOIN taxonomy t ON j.entity = t.entity"""
MAINJ = """SELECT journal, rows FROM (SELECT journal, count(*) AS rows FROM ejl GROUP BY journal ORDER BY rows DESC, journal LIMIT 10) m
WHERE journal <> 'Other'"""


def _jtc(level: int) -> str:
    return f"SELECT journal, Level_{level} AS topic, CAST(sum(count) AS BIGINT) AS size FROM ejl GROUP BY journal, Level_{level}"


def _o(body: str, extra=None) -> str:
    ex = dict(NBASE)
    ex["ejl"] = EJL
    ex["mainj"] = MAINJ
    ex.update(extra or {})
    return with_views(body, "doc_entities", "works", "taxonomy", extra=ex)


def _ejl(spark, sf):
    t = tables(spark, sf)
    return J.entity_journal_levels(NM.journal_entity_counts(_je(spark, sf)), t.taxonomy, 5)


@query("entity_journal_levels", oracle=_o("SELECT * FROM ejl"))
def q_entity_journal_levels(spark, sf):
    return _ejl(spark, sf)


@query("main_journals", oracle=_o("SELECT journal, rows FROM mainj"))
def q_main_journals(spark, sf):
    return J.main_journals(_ejl(spark, sf), 10)


REL = """SELECT journal, topic, size, total, round(size / total, 6) AS value FROM (
  SELECT journal, topic, size, sum(size) OVER (PARTITION BY journal) AS total,
    coalesce(sum(size) OVER (PARTITION BY journal ORDER BY size DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM jtc) x WHERE before <= 0.8 * total"""


@query("relevant_topics", oracle=_o(REL, extra={"jtc": _jtc(2)}))
def q_relevant_topics(spark, sf):
    return finish(J.relevant_topics(_ejl(spark, sf), 2, 0.8), floats=("value",))


@query("journal_topic_unary", oracle=_o("""
SELECT r.*, count(*) OVER (PARTITION BY r.journal) AS diversity,
  CAST(split_part(r.topic, '_', -1) AS INT) AS topic_number
FROM rel r WHERE r.journal IN (SELECT journal FROM mainj)""", extra={"jtc": _jtc(1), "rel": REL}))
def q_journal_topic_unary(spark, sf):
    return finish(J.journal_topic_unary(_ejl(spark, sf), 1, 0.8, 10), floats=("value",))


@query("journal_topic_frequency", oracle=_o("""
SELECT journal, topic, size, round(size / sum(size) OVER (PARTITION BY journal), 6) AS frequency
FROM jtc WHERE journal IN (SELECT journal FROM mainj)""", extra={"jtc": _jtc(2)}))
def q_journal_topic_frequency(spark, sf):
    return finish(J.journal_topic_frequency(_ejl(spark, sf), 2, 10), floats=("frequency",))


@query("journal_topic_tfidf", oracle=_o("""
SELECT * FROM (
  SELECT c.journal, c.topic, c.size, round(c.size / sum(c.size) OVER (PARTITION BY c.journal), 6) AS tf,
    round(ln((SELECT count(DISTINCT journal) FROM jtc) / d.df), 6) AS idf,
    round(c.size / sum(c.size) OVER (PARTITION BY c.journal) * ln((SELECT count(DISTINCT journal) FROM jtc) / d.df), 6) AS tfidf
  FROM jtc c JOIN (SELECT topic, count(DISTINCT journal) AS df FROM jtc GROUP BY topic) d ON c.topic = d.topic) x
WHERE journal IN (SELECT journal FROM mainj) AND tfidf > 0""", extra={"jtc": _jtc(5)}))
def q_journal_topic_tfidf(spark, sf):
    return finish(J.journal_topic_tfidf(_ejl(spark, sf), 5, 10), floats=("tf", "idf", "tfidf"))


@query("journal_dominance", oracle=_o(
    "SELECT journal, round(100.0E0 * max(size) / sum(size), 6) AS dominance FROM jtc GROUP BY journal",
    extra={"jtc": _jtc(2)}))
def q_journal_dominance(spark, sf):
    return finish(J.journal_dominance(J.journal_topic_counts(_ejl(spark, sf), 2)), floats=("dominance",))


@query("parent_topic_totals", oracle=_o(
    "SELECT Level_1 AS parent, CAST(sum(count) AS BIGINT) AS total FROM ejl GROUP BY Level_1"))
def q_parent_topic_totals(spark, sf):
    return J.parent_topic_totals(_ejl(spark, sf), 2)


@query("topic_id_number", oracle=_o(
    "SELECT DISTINCT Level_3 AS topic, CAST(split_part(Level_3, '_', -1) AS INT) AS number FROM ejl"))
def q_topic_id_number(spark, sf):
    return J.topic_id_number(_ejl(spark, sf), 3)


def _rollup_sql(src: str, path: list[str]) -> str:
    parts = []
    for d in range(1, len(path) + 1):
        cols = path[:d]
        pid = " || ' - ' || ".join(f"CAST({c} AS STRING)" for c in cols[:-1]) if d > 1 else "''"
        iid = " || ' - ' || ".join(f"CAST({c} AS STRING)" for c in cols)
        parts.append(f"""SELECT {iid} AS id, CAST({cols[-1]} AS STRING) AS label, {pid} AS parent, {d} AS depth,
  CAST(sum(count) AS BIGINT) AS value FROM {src} GROUP BY {', '.join(cols)}""")
    return "\nUNION ALL\n".join(parts)


@query("rollup_topic_entity", oracle=_o(_rollup_sql("ejl", ["Level_1", "Level_2", "entity"])))
def q_rollup_topic_entity(spark, sf):
    return R.rollup_topic_entity(_ejl(spark, sf), 2)


@query("rollup_entity_journal", oracle=_o(_rollup_sql("ejl", ["entity", "journal"])))
def q_rollup_entity_journal(spark, sf):
    return R.rollup_entity_journal(_ejl(spark, sf))


@query("rollup_journal_topic", oracle=_o(_rollup_sql(
    "(SELECT * FROM ejl WHERE journal IN (SELECT journal FROM mainj)) e", ["journal", "Level_1", "entity"])))
def q_rollup_journal_topic(spark, sf):
    ejl = _ejl(spark, sf)
    return R.rollup_journal_topic(ejl, J.main_journals(ejl, 10), 1)


@query("main_entities", oracle=_o("""
SELECT entity, total, rank, rank <= 10 AS top_10, rank <= 25 AS top_25, rank <= 50 AS top_50 FROM (
  SELECT entity, CAST(sum(count) AS BIGINT) AS total, row_number() OVER (ORDER BY sum(count) DESC, entity) AS rank
  FROM ejl GROUP BY entity) x WHERE rank <= 50"""))
def q_main_entities(spark, sf):
    return R.main_entities(_ejl(spark, sf))


@query("topic_density", oracle=_o("""
SELECT name, n, round(n / sum(n) OVER (), 6) AS density FROM (
  SELECT coalesce(e.names, 'Other') AS name, count(*) AS n FROM taxonomy t LEFT JOIN en2 e ON e.topic = t.Level_2
  GROUP BY coalesce(e.names, 'Other')) x ORDER BY n DESC, name LIMIT 20""", extra={
    "lec2": "SELECT t.Level_2 AS topic, c.entity, c.count FROM ecount c JOIN taxonomy t ON c.entity = t.entity",
    "en2": """SELECT topic, string_agg(entity, ', ' ORDER BY rn) AS names FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY count DESC, entity) AS rn FROM lec2) t WHERE rn <= 2 GROUP BY topic"""}))
def q_topic_density(spark, sf):
    t = tables(spark, sf)
    names = NM.topic_entity_names(NM.level_entity_counts(_je(spark, sf), t.taxonomy, 2), 2)
    named = (t.taxonomy.join(names.withColumnRenamed("topic", "Level_2"), "Level_2", "left")
             .withColumn("Level_2_Entity_Names", F.coalesce("names", F.lit("Other"))))
    return finish(J.topic_density(named, 2, 20), floats=("density",))


# -- inside a parent topic, samples, named paths ------------------------------------------
IN1 = {"pejl": "SELECT * FROM ejl WHERE Level_1 = '1'",
       "pjtc": "SELECT journal, Level_2 AS topic, CAST(sum(count) AS BIGINT) AS size FROM pejl GROUP BY journal, Level_2",
       "pmain": """SELECT journal FROM (SELECT journal, count(*) AS rows FROM pejl GROUP BY journal ORDER BY rows DESC, journal LIMIT 10) m
WHERE journal <> 'Other'"""}


@query("sample_journals", oracle=_o(f"SELECT journal FROM (SELECT DISTINCT journal FROM pejl) j ORDER BY {unit_hash('journal', 4)}, journal LIMIT 5",
                                    extra=IN1))
def q_sample_journals(spark, sf):
    return J.sample_journals(_ejl(spark, sf), 5, 2, "1", seed=4)


@query("relevant_topics_in_parent", oracle=_o("SELECT * FROM prel", extra=IN1 | {"prel": REL.replace("jtc", "pjtc")}))
def q_relevant_topics_in_parent(spark, sf):
    return finish(J.relevant_topics(J.inside(_ejl(spark, sf), 2, "1"), 2, 0.8), floats=("value",))


@query("journal_topic_unary_in_parent", oracle=_o("""
SELECT r.*, count(*) OVER (PARTITION BY r.journal) AS diversity, CAST(split_part(r.topic, '_', -1) AS INT) AS topic_number
FROM prel r WHERE r.journal IN (SELECT journal FROM pmain)""", extra=IN1 | {"prel": REL.replace("jtc", "pjtc")}))
def q_journal_topic_unary_in_parent(spark, sf):
    return finish(J.journal_topic_unary(_ejl(spark, sf), 2, 0.8, 10, "1"), floats=("value",))


@query("journal_topic_frequency_in_parent", oracle=_o("""
SELECT journal, topic, size, round(size / sum(size) OVER (PARTITION BY journal), 6) AS frequency
FROM pjtc WHERE journal IN (SELECT journal FROM pmain)""", extra=IN1))
def q_journal_topic_frequency_in_parent(spark, sf):
    return finish(J.journal_topic_frequency(_ejl(spark, sf), 2, 10, "1"), floats=("frequency",))


def _named(sql: str) -> dict[str, str]:
    return {"nejl": f"""SELECT e.entity, e.journal, e.count, coalesce(a.name, e.Level_1) AS Level_1, coalesce(b.name, e.Level_2) AS Level_2
FROM ({sql}) e LEFT JOIN (SELECT topic, name FROM topic_names WHERE level = 1) a ON a.topic = e.Level_1
LEFT JOIN (SELECT topic, name FROM topic_names WHERE level = 2) b ON b.topic = e.Level_2"""}


def _names(spark, sf):
    n = tables(spark, sf).topic_names
    return {lv: n.where(F.col("level") == lv) for lv in (1, 2)}


TOP50 = "SELECT entity FROM (SELECT entity, sum(count) AS s FROM ejl GROUP BY entity ORDER BY s DESC, entity LIMIT 50) x"


@query("rollup_topic_entity_named", oracle=with_views(_rollup_sql("nejl", ["Level_1", "Level_2", "entity", "journal"]),
    "doc_entities", "works", "taxonomy", "topic_names",
    extra=dict(NBASE) | {"ejl": EJL} | _named(f"SELECT * FROM ejl WHERE entity IN ({TOP50}) AND Level_1 = '1'")))
def q_rollup_topic_entity_named(spark, sf):
    """The 50 top entities of one first-level cluster, by name, down to the journal."""
    ejl = _ejl(spark, sf)
    return R.rollup_topic_entity(ejl, 2, True, _names(spark, sf), R.main_entities(ejl, (50,)), "1")


@query("rollup_entity_journal_top", oracle=_o(_rollup_sql(f"(SELECT * FROM ejl WHERE entity IN ({TOP50})) t", ["entity", "journal"])))
def q_rollup_entity_journal_top(spark, sf):
    ejl = _ejl(spark, sf)
    return R.rollup_entity_journal(ejl, R.main_entities(ejl, (50,)))


@query("rollup_journal_topic_named", oracle=with_views(_rollup_sql("nejl", ["journal", "Level_1", "Level_2", "entity"]),
    "doc_entities", "works", "taxonomy", "topic_names",
    extra=dict(NBASE) | {"ejl": EJL, "mainj": MAINJ} | _named("SELECT * FROM ejl WHERE journal = (SELECT min(journal) FROM mainj)")))
def q_rollup_journal_topic_named(spark, sf):
    """One main journal (the first by name), topics by name."""
    ejl = _ejl(spark, sf)
    main = J.main_journals(ejl, 10)
    first = main.agg(F.min("journal").alias("journal"))
    return R.rollup_journal_topic(ejl, first, 2, names=_names(spark, sf))
