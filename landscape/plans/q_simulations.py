"""Registered queries over taxonomy simulation runs. Runs are hash samples of
the taxonomy, which the oracles draw again in SQL."""

from __future__ import annotations

from ..operators import entities as E
from ..operators import simulations as S
from ..session import scratch_path
from ..sources.nested import write_simulation_runs
from .registry import finish, query, r6, tables
from .sqlhelp import top_names, unit_hash
from .views_sql import with_views

RATIOS = [10, 25, 50]
LEVELS = (1, 2, 3, 4, 5)

RUNS = {
    "runs": f"""
SELECT 'community_sample_' || CAST(r.ratio AS STRING) || '_simul_' || CAST(s.simul AS STRING) AS run, CAST(r.ratio AS STRING) AS ratio,
  t.entity, t.Level_1, t.Level_2, t.Level_3, t.Level_4, t.Level_5
FROM taxonomy t CROSS JOIN (VALUES (10), (25), (50)) r(ratio) CROSS JOIN (VALUES (0), (1)) s(simul)
WHERE {unit_hash("t.entity || '|' || CAST(s.simul AS STRING)", 17)} < r.ratio / 100.0E0""",
    "unp": " UNION ALL ".join(f"SELECT run, ratio, entity, 'Level_{i}' AS level, Level_{i} AS topic FROM runs" for i in LEVELS),
}


def _o(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    return with_views(body, "taxonomy", *views, extra=RUNS | (extra or {}))


def _runs(spark, sf):
    t = tables(spark, sf)
    if "simulation_runs" not in t._stages:
        path = scratch_path(spark, "simulation-runs")
        write_simulation_runs(t.taxonomy, path, RATIOS, runs=2)
        t._stages["simulation_runs"] = S.read_simulation_runs(spark, path)
    return t._stages["simulation_runs"]


@query("read_simulation_runs", oracle=_o("SELECT * FROM runs"))
def q_read_simulation_runs(spark, sf):
    return _runs(spark, sf)


@query("query_sizes", oracle=_o("""
SELECT u.run, u.ratio, u.level || '_ratio_' || u.ratio AS level, u.topic, count(*) AS size, coalesce(n.name, 'No Name') AS "TopicName"
FROM unp u LEFT JOIN topic_names n ON 'Level_' || CAST(n.level AS STRING) = u.level AND n.topic = u.topic
WHERE u.ratio IN ('10', '25') AND u.level IN ('Level_1', 'Level_2', 'Level_3')
GROUP BY u.run, u.ratio, u.level, u.topic, n.name""", "topic_names"))
def q_query_sizes(spark, sf):
    return S.query_sizes(_runs(spark, sf), tables(spark, sf).topic_names, ["10", "25"], [1, 2, 3])


@query("query_distances", oracle=_o("""
SELECT x.run, x.ratio, x.level, x.topic, x.entity,
  CASE WHEN s.n > 1 THEN round(sqrt(sum((x.x - m.mu) * (x.x - m.mu))), 4) END AS distance
FROM x JOIN (SELECT run, level, topic, dim, avg(x) AS mu FROM x GROUP BY run, level, topic, dim) m
  ON m.run = x.run AND m.level = x.level AND m.topic = x.topic AND m.dim = x.dim
JOIN (SELECT run, level, topic, count(DISTINCT entity) AS n FROM x GROUP BY run, level, topic) s
  ON s.run = x.run AND s.level = x.level AND s.topic = x.topic
WHERE regexp_matches(lower(x.entity), 'e1|e4')
GROUP BY x.run, x.ratio, x.level, x.topic, x.entity, s.n""", "entity_embeddings", extra={
    "x": """SELECT u.*, e.dim, e.x FROM unp u JOIN (
        SELECT entity, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x
        FROM entity_embeddings) e ON u.entity = e.entity WHERE u.ratio = '25' AND u.level IN ('Level_1', 'Level_2')"""}))
def q_query_distances(spark, sf):
    t = tables(spark, sf)
    d = S.query_distances(_runs(spark, sf), t.entity_embeddings, ["25"], [1, 2], ["e1", "E4"])
    return d.withColumn("distance", r6("distance", 4))


@query("run_topic_names", oracle=_o("SELECT run, level, topic, names AS name FROM (" + top_names(
    "c", "run, level, topic", "entity", "cnt", 10) + ") q", "doc_entities", extra={
        "c": """SELECT u.run, u.level, u.topic, u.entity, k.cnt FROM unp u JOIN (
            SELECT entity, count(*) AS cnt FROM doc_entities WHERE confidence >= 70 GROUP BY entity) k ON k.entity = u.entity"""}))
def q_run_topic_names(spark, sf):
    t = tables(spark, sf)
    return S.run_topic_names(_runs(spark, sf), E.entities_kept(t.doc_entities, 70))


@query("pairwise_long", oracle=_o("""
SELECT a.run, a.ratio, a.area, a.discipline, a.level, round(avg(CASE WHEN a.topic = b.topic THEN 1.0E0 ELSE 0.0E0 END), 6) AS prop
FROM g a JOIN g b ON a.run = b.run AND a.area = b.area AND a.discipline = b.discipline AND a.level = b.level AND a.entity < b.entity
GROUP BY a.run, a.ratio, a.area, a.discipline, a.level""", "entity_groups", extra={
    "g": "SELECT u.*, e.area, e.discipline FROM unp u JOIN entity_groups e ON e.entity = u.entity"}))
def q_pairwise_long(spark, sf):
    return finish(S.pairwise_long(_runs(spark, sf), tables(spark, sf).entity_groups), floats=("prop",))


@query("pairwise_long_subtopics", oracle=_o("""
SELECT a.run, a.ratio, a.area, a.discipline, a.subtopic, a.level, round(avg(CASE WHEN a.topic = b.topic THEN 1.0E0 ELSE 0.0E0 END), 6) AS prop
FROM g a JOIN g b ON a.run = b.run AND a.area = b.area AND a.discipline = b.discipline AND a.subtopic = b.subtopic AND a.level = b.level AND a.entity < b.entity
GROUP BY ALL""", "entity_groups", extra={
    "g": "SELECT u.*, e.area, e.discipline, CAST(substr(e.entity, 2) AS BIGINT) % 3 AS subtopic FROM unp u JOIN entity_groups e ON e.entity = u.entity"}))
def q_pairwise_long_subtopics(spark, sf):
    groups = tables(spark, sf).entity_groups.selectExpr("area", "discipline", "entity", "CAST(substr(entity, 2) AS BIGINT) % 3 AS subtopic")
    return finish(S.pairwise_long(_runs(spark, sf), groups, ("area", "discipline", "subtopic")), floats=("prop",))
