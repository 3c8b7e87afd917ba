"""Registered taxonomy-validation queries (2.K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .registry import finish, query, r6, tables
from .views_sql import with_views

UNP = " UNION ALL ".join(f"SELECT entity, {i} AS level, Level_{i} AS topic FROM taxonomy" for i in range(1, 6))
BASE = {"unp": UNP, "tc": "SELECT level, topic, count(*) AS n FROM unp GROUP BY level, topic"}


def _o(body: str, *views, extra=None) -> str:
    ex = dict(BASE)
    ex.update(extra or {})
    return with_views(body, "taxonomy", *views, extra=ex)


def _tax(spark, sf):
    return tables(spark, sf).taxonomy


@query("tax_chisq", oracle=_o("""
SELECT level, round(sum((n - e) * (n - e) / e), 6) AS chisq FROM (
  SELECT level, n, sum(n) OVER (PARTITION BY level) / count(*) OVER (PARTITION BY level) AS e FROM tc) x GROUP BY level"""))
def q_tax_chisq(spark, sf):
    return finish(V.tax_chisq(_tax(spark, sf)), floats=("chisq",))


@query("tax_kl_uniform", oracle=_o("""
SELECT level, round(sum(p * ln(p / q)), 6) AS kl FROM (
  SELECT level, 1.0E0 / count(*) OVER (PARTITION BY level) AS p, n / sum(n) OVER (PARTITION BY level) AS q FROM tc) x
GROUP BY level"""))
def q_tax_kl_uniform(spark, sf):
    return finish(V.tax_kl_uniform(_tax(spark, sf)), floats=("kl",))


@query("tax_topic_counts", oracle=_o("SELECT level, count(DISTINCT topic) AS n_topics FROM unp GROUP BY level"))
def q_tax_topic_counts(spark, sf):
    return V.tax_topic_counts(_tax(spark, sf))


@query("tax_split_fraction", oracle=_o("""
SELECT a.level, round(avg(CASE WHEN b.topic IS NULL THEN 1.0E0 ELSE 0.0E0 END), 6) AS split_fraction
FROM (SELECT DISTINCT level, topic FROM unp WHERE level < 5) a
LEFT JOIN (SELECT DISTINCT level - 1 AS level, topic FROM unp) b ON a.level = b.level AND a.topic = b.topic
GROUP BY a.level"""))
def q_tax_split_fraction(spark, sf):
    return finish(V.tax_split_fraction(_tax(spark, sf)), floats=("split_fraction",))


GP = {"gp": """
SELECT a.area, a.discipline, a.entity AS e1, b.entity AS e2
FROM (SELECT DISTINCT area, discipline, entity FROM entity_groups) a
JOIN (SELECT DISTINCT area, discipline, entity FROM entity_groups) b
  ON a.area = b.area AND a.discipline = b.discipline AND a.entity < b.entity""",
      "gpl": """SELECT g.area, g.discipline, g.e1, g.e2, u1.level, u1.topic AS t1, u2.topic AS t2
FROM gp g JOIN unp u1 ON u1.entity = g.e1 JOIN unp u2 ON u2.entity = g.e2 AND u2.level = u1.level"""}


@query("pairwise_depth", oracle=_o("""
SELECT area, discipline, round(avg(d), 6) AS depth, count(*) AS n_pairs FROM (
  SELECT g.area, g.discipline, g.e1, g.e2,
    (SELECT count(*) FROM (SELECT topic FROM unp WHERE entity = g.e1 INTERSECT SELECT topic FROM unp WHERE entity = g.e2) i) AS d
  FROM gp g) x GROUP BY area, discipline""", "entity_groups", extra=GP))
def q_pairwise_depth(spark, sf):
    t = tables(spark, sf)
    return finish(V.pairwise_depth(t.taxonomy, t.entity_groups), floats=("depth",))


@query("pairwise_survival", oracle=_o("""
SELECT area, discipline, level, round(avg(CASE WHEN t1 = t2 THEN 1 ELSE 0 END), 6) AS share_same_topic,
  CAST(sum(CASE WHEN t1 = t2 THEN 1 ELSE 0 END) AS BIGINT) AS pairs_same_topic
FROM gpl GROUP BY area, discipline, level""", "entity_groups", extra=GP))
def q_pairwise_survival(spark, sf):
    t = tables(spark, sf)
    return finish(V.pairwise_survival(t.taxonomy, t.entity_groups), floats=("share_same_topic",))


SUB = "area, discipline, topic"
#: the groups with a third key: subtopics of a discipline
SUBGROUPS = "SELECT area, discipline, 't' || CAST(CAST(substr(entity, 2) AS BIGINT) % 3 AS STRING) AS topic, entity FROM entity_groups"
SGP = {"sg": SUBGROUPS, "sgp": f"""
SELECT a.area, a.discipline, a.topic, a.entity AS e1, b.entity AS e2 FROM sg a JOIN sg b USING (area, discipline, topic) WHERE a.entity < b.entity"""}


def _subgroups(spark, sf):
    number = F.expr("CAST(substr(entity, 2) AS BIGINT) % 3")
    return tables(spark, sf).entity_groups.withColumn("topic", F.concat(F.lit("t"), number.cast("string")))


@query("pairwise_depth_subtopics", oracle=_o(f"""
SELECT {SUB}, round(avg(d), 6) AS depth, count(*) AS n_pairs FROM (
  SELECT g.*, (SELECT count(*) FROM (SELECT topic FROM unp WHERE entity = g.e1 INTERSECT SELECT topic FROM unp WHERE entity = g.e2) i) AS d
  FROM sgp g) x GROUP BY {SUB}""", "entity_groups", extra=SGP))
def q_pairwise_depth_subtopics(spark, sf):
    return finish(V.pairwise_depth(_tax(spark, sf), _subgroups(spark, sf), ("area", "discipline", "topic")), floats=("depth",))


@query("pairwise_survival_subtopics", oracle=_o(f"""
SELECT g.area, g.discipline, g.topic AS subtopic, u1.level, round(avg(CASE WHEN u1.topic = u2.topic THEN 1 ELSE 0 END), 6) AS share_same_topic,
  CAST(sum(CASE WHEN u1.topic = u2.topic THEN 1 ELSE 0 END) AS BIGINT) AS pairs_same_topic
FROM sgp g JOIN unp u1 ON u1.entity = g.e1 JOIN unp u2 ON u2.entity = g.e2 AND u2.level = u1.level GROUP BY 1, 2, 3, 4""", "entity_groups", extra=SGP))
def q_pairwise_survival_subtopics(spark, sf):
    groups = _subgroups(spark, sf).withColumnRenamed("topic", "subtopic")
    return finish(V.pairwise_survival(_tax(spark, sf), groups, ("area", "discipline", "subtopic")), floats=("share_same_topic",))


@query("surviving_pairs", oracle=_o("""
SELECT area, discipline, level, t1 AS topic, e1 AS entity_1, e2 AS entity_2 FROM gpl WHERE t1 = t2""", "entity_groups", extra=GP))
def q_surviving_pairs(spark, sf):
    t = tables(spark, sf)
    return V.surviving_pairs(t.taxonomy, t.entity_groups)


ALL_GROUPS = """SELECT CASE WHEN label % 2 = 0 THEN 'natural' ELSE 'social' END AS area, 'd' || CAST(label AS STRING) AS discipline, entity
FROM entity_embeddings WHERE CAST(substr(entity, 2) AS BIGINT) % 3 = 0"""


@query("dropped_group_entities", oracle=_o(
    f"SELECT * FROM ({ALL_GROUPS}) g WHERE entity NOT IN (SELECT entity FROM taxonomy)", "entity_embeddings"))
def q_dropped_group_entities(spark, sf):
    t = tables(spark, sf)
    groups = t.entity_embeddings.where("CAST(substr(entity, 2) AS BIGINT) % 3 = 0").select(
        F.when(F.col("label") % 2 == 0, "natural").otherwise("social").alias("area"),
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("discipline"), "entity")
    return V.dropped_entities(t.taxonomy, groups)


@query("topic_sizes", oracle=_o("""
SELECT c.level, c.topic, c.n AS size, round(c.n / (SELECT count(*) FROM taxonomy), 5) AS share,
  split_part(c.topic, '_', 1) AS parent, n.name
FROM tc c LEFT JOIN topic_names n ON n.level = c.level AND n.topic = c.topic""", "topic_names"))
def q_topic_sizes(spark, sf):
    t = tables(spark, sf)
    return V.topic_sizes(t.taxonomy, t.topic_names)


CD = {"cdx": """SELECT u.level, u.topic, u.entity, e.dim, e.x FROM unp u JOIN (
        SELECT entity, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
        FROM entity_embeddings) e ON u.entity = e.entity""",
      "cdd": """SELECT x.level, x.topic, x.entity,
        CASE WHEN s.n > 1 THEN sqrt(sum((x.x - m.mu) * (x.x - m.mu))) END AS distance
      FROM cdx x JOIN (SELECT level, topic, dim, avg(x) AS mu FROM cdx GROUP BY level, topic, dim) m
        ON m.level = x.level AND m.topic = x.topic AND m.dim = x.dim
      JOIN (SELECT level, topic, count(DISTINCT entity) AS n FROM cdx GROUP BY level, topic) s
        ON s.level = x.level AND s.topic = x.topic
      GROUP BY x.level, x.topic, x.entity, s.n"""}


@query("centroid_distances", oracle=_o("SELECT level, topic, entity, round(distance, 4) AS distance FROM cdd",
                                       "entity_embeddings", extra=CD))
def q_centroid_distances(spark, sf):
    t = tables(spark, sf)
    d = V.centroid_distances(t.taxonomy, t.entity_embeddings)
    return d.withColumn("distance", r6("distance", 4))


@query("distance_timeseries", oracle=_o("""
SELECT level, round(avg(distance), 4) AS mean, round(stddev_samp(distance), 4) AS std,
  round(avg(distance) + stddev_samp(distance), 4) AS upper, round(avg(distance) - stddev_samp(distance), 4) AS lower
FROM cdd GROUP BY level""", "entity_embeddings", extra=CD))
def q_distance_timeseries(spark, sf):
    t = tables(spark, sf)
    out = V.distance_timeseries(V.centroid_distances(t.taxonomy, t.entity_embeddings))
    for c in ("mean", "std", "upper", "lower"):
        out = out.withColumn(c, r6(c, 4))
    return out


@query("entity_level_vector", oracle=_o("SELECT entity, " + ", ".join(
    f"coalesce(TRY_CAST(split_part(Level_5, '_', {i}) AS INT), 0) AS l{i}" for i in range(1, 6)) + " FROM taxonomy"))
def q_entity_level_vector(spark, sf):
    return V.entity_level_vector(_tax(spark, sf))


@query("metrics_long", oracle=_o("""
SELECT 'fixture' AS algorithm, level, 'counts' AS metric, CAST(count(DISTINCT topic) AS DOUBLE) AS value FROM unp GROUP BY level
UNION ALL
SELECT 'fixture', a.level, 'split_fraction', round(avg(CASE WHEN b.topic IS NULL THEN 1.0E0 ELSE 0.0E0 END), 6)
FROM (SELECT DISTINCT level, topic FROM unp WHERE level < 5) a
LEFT JOIN (SELECT DISTINCT level - 1 AS level, topic FROM unp) b ON a.level = b.level AND a.topic = b.topic GROUP BY a.level
UNION ALL
SELECT 'fixture', level, 'kl', round(sum(p * ln(p / q)), 6) FROM (
  SELECT level, 1.0E0 / count(*) OVER (PARTITION BY level) AS p, n / sum(n) OVER (PARTITION BY level) AS q FROM tc) x GROUP BY level
UNION ALL
SELECT 'fixture', level, 'chisq', round(sum((n - e) * (n - e) / e), 6) FROM (
  SELECT level, n, sum(n) OVER (PARTITION BY level) / count(*) OVER (PARTITION BY level) AS e FROM tc) x GROUP BY level"""))
def q_metrics_long(spark, sf):
    return finish(V.metrics_long({"fixture": _tax(spark, sf)}), floats=("value",))


def _metrics_sql(name, tax):
    """All metrics of one taxonomy, pairs one by one."""
    unp = " UNION ALL ".join(f"SELECT entity, {i} AS level, Level_{i} AS topic FROM {tax}" for i in range(1, 6))
    return f"""SELECT * FROM (
WITH u AS ({unp}), c AS (SELECT level, topic, count(*) AS n FROM u GROUP BY level, topic)
SELECT '{name}' AS algorithm, level, 'counts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c GROUP BY level
UNION ALL
SELECT '{name}', a.level, 'split_fraction', round(avg(CASE WHEN b.topic IS NULL THEN 1.0E0 ELSE 0.0E0 END), 6)
FROM (SELECT * FROM c WHERE level < 5) a LEFT JOIN (SELECT level - 1 AS level, topic FROM c) b ON a.level = b.level AND a.topic = b.topic GROUP BY a.level
UNION ALL
SELECT '{name}', level, 'kl', round(sum(p * ln(p / q)), 6) FROM (
  SELECT level, 1.0E0 / count(*) OVER (PARTITION BY level) AS p, n / sum(n) OVER (PARTITION BY level) AS q FROM c) x GROUP BY level
UNION ALL
SELECT '{name}', level, 'chisq', round(sum((n - e) * (n - e) / e), 6) FROM (
  SELECT level, n, sum(n) OVER (PARTITION BY level) / count(*) OVER (PARTITION BY level) AS e FROM c) x GROUP BY level
UNION ALL
SELECT '{name}', 0, 'depth', round(avg(d), 6) FROM (
  SELECT g.area, g.discipline, g.e1, g.e2, count(DISTINCT a.topic) FILTER (WHERE a.topic IN (SELECT topic FROM u WHERE entity = g.e2)) AS d
  FROM gp g JOIN u a ON a.entity = g.e1 WHERE g.e2 IN (SELECT entity FROM {tax}) GROUP BY ALL) y) z"""


@query("metrics_long_taxonomies", oracle=_o(
    _metrics_sql("whole", "taxonomy") + " UNION ALL " + _metrics_sql("pruned", "(SELECT * FROM taxonomy WHERE Level_1 <> '2')"),
    "entity_groups", extra=GP))
def q_metrics_long_taxonomies(spark, sf):
    """Two taxonomies side by side, with the depth of known pairs."""
    whole = _tax(spark, sf)
    both = {"whole": whole, "pruned": whole.where("Level_1 <> '2'")}
    return finish(V.metrics_long(both, tables(spark, sf).entity_groups), floats=("value",))


@query("level_drilldown_counts", oracle=_o(
    "SELECT Level_2 AS topic, count(*) AS n_entities FROM taxonomy WHERE Level_1 = '2' GROUP BY Level_2"))
def q_level_drilldown_counts(spark, sf):
    return V.level_drilldown_counts(_tax(spark, sf), {1: "2"})


LABELLED = """SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label,
  CAST(50 + 10 * (doc_id % 6) AS INT) AS confidence, quality AS truth, toxic AS predicted FROM labels"""


def _labelled(spark, sf):
    lb = tables(spark, sf).labels
    return lb.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"),
                     (F.lit(50) + F.lit(10) * (F.col("doc_id") % 6)).cast("int").alias("confidence"),
                     F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))


@query("confidence_sweep", oracle=with_views("""
SELECT t.threshold, round(avg(CASE WHEN l.confidence <= t.threshold THEN 1 ELSE 0 END), 6) AS removed,
  round(sum(CASE WHEN l.confidence >= t.threshold THEN (CASE WHEN l.label = 'good' THEN 1 ELSE 0 END) END)
        / sum(CASE WHEN l.confidence >= t.threshold THEN 1 END), 6) AS good
FROM lab l CROSS JOIN (SELECT unnest([60, 70, 80, 90]) AS threshold) t GROUP BY t.threshold""", extra={"lab": LABELLED}))
def q_confidence_sweep(spark, sf):
    return finish(V.confidence_sweep(_labelled(spark, sf)), floats=("removed", "good"))


@query("label_quality", oracle=with_views("""
SELECT label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence,
  round(quantile_cont(confidence, 0.5), 6) AS median_confidence FROM lab GROUP BY label""", extra={"lab": LABELLED}))
def q_label_quality(spark, sf):
    return finish(V.label_quality(_labelled(spark, sf)), floats=("mean_confidence", "median_confidence"))


@query("classification_scores", oracle=with_views("""
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1
FROM (SELECT CAST(sum(CASE WHEN truth = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN truth = 0 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN truth = 1 AND predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN truth = 0 AND predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM lab) c""",
    extra={"lab": LABELLED}))
def q_classification_scores(spark, sf):
    return finish(V.classification_scores(_labelled(spark, sf)), floats=("accuracy", "precision", "recall", "f1"))
