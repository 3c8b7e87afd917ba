"""Registered queries for entity selection and tagging (2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as E
from .registry import query, tables
from .sqlhelp import unit_hash
from .views_sql import with_views


@query("entities_kept", oracle=with_views(
    "SELECT doc_id, source, pos, entity, confidence FROM doc_entities WHERE confidence >= 80",
    "doc_entities"))
def q_entities_kept(spark, sf):
    return E.entities_kept(tables(spark, sf).doc_entities, 80)


@query("entities_discarded", oracle=with_views(
    "SELECT doc_id, source, pos, entity, confidence FROM doc_entities WHERE confidence < 80",
    "doc_entities"))
def q_entities_discarded(spark, sf):
    return E.entities_discarded(tables(spark, sf).doc_entities, 80)


@query("filter_entities_absolute", oracle=with_views("""
SELECT k.doc_id, k.source, k.pos, k.entity, k.confidence
FROM doc_entities k JOIN (
  SELECT entity FROM doc_entities WHERE confidence >= 80 GROUP BY entity HAVING count(*) BETWEEN 10 AND 40
) f ON k.entity = f.entity
WHERE k.confidence >= 80""", "doc_entities"))
def q_filter_entities_absolute(spark, sf):
    kept = E.entities_kept(tables(spark, sf).doc_entities, 80)
    return E.filter_entities_absolute(kept, 10, 40).select("doc_id", "source", "pos", "entity", "confidence")


@query("filter_entities_percentile", oracle=with_views("""
SELECT k.doc_id, k.source, k.pos, k.entity, k.confidence
FROM kept k JOIN freq f ON k.entity = f.entity
CROSS JOIN (SELECT quantile_cont(frequency, 0.1) AS lo, quantile_cont(frequency, 0.9) AS hi FROM freq) b
WHERE f.frequency >= b.lo AND f.frequency <= b.hi""", "doc_entities", extra={
    "kept": "SELECT * FROM doc_entities WHERE confidence >= 80",
    "freq": "SELECT entity, count(*) AS frequency FROM kept GROUP BY entity"}))
def q_filter_entities_percentile(spark, sf):
    kept = E.entities_kept(tables(spark, sf).doc_entities, 80)
    return E.filter_entities_percentile(kept, 10, 90).select("doc_id", "source", "pos", "entity", "confidence")


@query("sample_documents", oracle=with_views(f"""
SELECT doc_id, source, pos, entity, confidence FROM doc_entities
WHERE confidence >= 80 AND {unit_hash('doc_id', 7)} < 1000.0E0 / (SELECT count(DISTINCT doc_id) FROM doc_entities)""",
                                             "doc_entities"))
def q_sample_documents(spark, sf):
    # draw among all documents with any mention, then keep confident mentions
    sampled = E.sample_documents(tables(spark, sf).doc_entities, num_articles=1000, seed=7)
    return E.entities_kept(sampled, 80)


@query("distinct_entities", oracle=with_views("""
SELECT DISTINCT k.entity FROM doc_entities k JOIN (
  SELECT entity FROM doc_entities WHERE confidence >= 80 GROUP BY entity HAVING count(*) >= 10) f
  ON k.entity = f.entity
WHERE k.confidence >= 80""", "doc_entities"))
def q_distinct_entities(spark, sf):
    kept = E.entities_kept(tables(spark, sf).doc_entities, 80)
    return E.distinct_entities(E.filter_entities_absolute(kept, 10, 1 << 62))


@query("entity_document_index", oracle=with_views("""
SELECT DISTINCT k.entity, k.doc_id AS document FROM doc_entities k JOIN (
  SELECT entity FROM doc_entities WHERE confidence >= 80 GROUP BY entity HAVING count(*) >= 10) f
  ON k.entity = f.entity
WHERE k.confidence >= 80""", "doc_entities"))
def q_entity_document_index(spark, sf):
    return E.entity_document_index(tables(spark, sf).doc_entities, 80, 10)


@query("tag_documents", oracle=with_views(
    "SELECT doc_id, source, level, topic FROM doc_topics", "doc_topics"))
def q_tag_documents(spark, sf):
    # the tagging output is the shared document-topic table every indicator
    # reads: produce it once per session (staged by source, a row a mention)
    from .q_novelty import _topics
    return _topics(spark, sf).select("doc_id", "source", "level", "topic")


@query("article_assignments", oracle=with_views("""
SELECT DISTINCT e.doc_id, e.entity, t.Level_1 AS topic
FROM doc_entities e JOIN taxonomy t ON e.entity = t.entity""", "doc_entities", "taxonomy"))
def q_article_assignments(spark, sf):
    t = tables(spark, sf)
    return E.article_assignments(t.doc_entities, t.taxonomy, 1)


@query("article_topic_counts", oracle=with_views("""
SELECT e.doc_id, t.Level_1 AS topic, count(DISTINCT e.entity) AS n_entities
FROM doc_entities e JOIN taxonomy t ON e.entity = t.entity
GROUP BY e.doc_id, t.Level_1""", "doc_entities", "taxonomy"))
def q_article_topic_counts(spark, sf):
    t = tables(spark, sf)
    return E.article_topic_counts(E.article_assignments(t.doc_entities, t.taxonomy, 1))
