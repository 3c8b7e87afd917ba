"""Registered embedding-cluster queries (2.I). Estimator outputs depend on
seeds and are checked by invariants in tests; the label bookkeeping
operators are checked against SQL on the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from .registry import query, r6, tables
from .sqlhelp import unit_hash
from .views_sql import with_views

LV = ["Level_1", "Level_2", "Level_3"]
L5 = [*LV, "Level_4", "Level_5"]
FRACTIONS = [round(10 ** (-1 + i / 9), 4) for i in range(10)]


def _emb(spark, sf):
    return tables(spark, sf).entity_embeddings


@query("kmeans_flat")
def q_kmeans_flat(spark, sf):
    return C.kmeans_flat(_emb(spark, sf), 10)


@query("fuzzy_multi_resolution")
def q_fuzzy_multi_resolution(spark, sf):
    return C.fuzzy_multi_resolution(_emb(spark, sf), [5, 10, 20])


@query("kmeans_centroid_hierarchy")
def q_kmeans_centroid_hierarchy(spark, sf):
    return C.kmeans_centroid_hierarchy(_emb(spark, sf), [40, 10, 3])


@query("bisecting_hierarchy")
def q_bisecting_hierarchy(spark, sf):
    return C.bisecting_hierarchy(_emb(spark, sf), [2, 4, 8])


@query("pca_reduce")
def q_pca_reduce(spark, sf):
    return C.pca_reduce(_emb(spark, sf))


@query("gmm_overlap")
def q_gmm_overlap(spark, sf):
    return C.gmm_overlap(C.pca_reduce(_emb(spark, sf)), 5)


def _silhouette_sql(levels):
    """Every pair of entities, level by level."""
    paths = ", ".join(f"concat_ws('_', {', '.join(levels[:i + 1])}) AS p{i + 1}" for i in range(len(levels)))
    one = " UNION ALL ".join(f"""
SELECT {i + 1} AS level, coalesce(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 0) AS s
FROM (SELECT e, sum(CASE WHEN own THEN d END) / nullif(max(CASE WHEN own THEN n END) - 1, 0) AS a, min(CASE WHEN NOT own THEN d / n END) AS b
  FROM (SELECT x.entity AS e, y.p{i + 1} AS c, x.p{i + 1} = y.p{i + 1} AS own, sum(d) AS d, count(*) AS n
    FROM pairs JOIN pts x ON x.entity = pairs.x JOIN pts y ON y.entity = pairs.y GROUP BY 1, 2, 3) q GROUP BY e) q2""" for i in range(len(levels)))
    return f"""SELECT level, round(s * 1e6) / 1e6 AS silhouette FROM (
WITH pts AS MATERIALIZED (SELECT entity, CAST(embedding AS DOUBLE[]) AS v, {paths} FROM entity_embeddings JOIN taxonomy USING (entity)),
pairs AS MATERIALIZED (SELECT x.entity AS x, y.entity AS y, list_distance(x.v, y.v) AS d FROM pts x, pts y)
{one}) t"""


@query("silhouette_by_level", oracle=with_views(_silhouette_sql(L5), "entity_embeddings", "taxonomy"))
def q_silhouette_by_level(spark, sf):
    t = tables(spark, sf)
    return C.silhouette_by_level(_emb(spark, sf), t.taxonomy, L5).select("level", r6("silhouette").alias("silhouette"))


@query("dendrogram_hierarchy")
def q_dendrogram_hierarchy(spark, sf):
    return C.dendrogram_hierarchy(_emb(spark, sf), [2, 4, 8, 16])


@query("cluster_sizes", oracle=with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS level, {c} AS cluster, count(*) AS n FROM taxonomy GROUP BY {c}" for c in L5), "taxonomy"))
def q_cluster_sizes(spark, sf):
    return C.cluster_sizes(tables(spark, sf).taxonomy, L5)


@query("cluster_members", oracle=with_views("SELECT entity FROM taxonomy WHERE Level_2 = '1_2'", "taxonomy"))
def q_cluster_members(spark, sf):
    return C.cluster_members(tables(spark, sf).taxonomy, "Level_2", "1_2")


@query("label_paths", oracle=with_views("""
SELECT entity, split_part(Level_5, '_', 1) AS Level_1,
  concat_ws('_', split_part(Level_5, '_', 1), nullif(split_part(Level_5, '_', 4), '')) AS Level_2,
  concat_ws('_', split_part(Level_5, '_', 1), nullif(split_part(Level_5, '_', 4), ''), nullif(split_part(Level_5, '_', 5), '')) AS Level_3
FROM taxonomy""", "taxonomy"))
def q_label_paths(spark, sf):
    # raw per-level labels: first, fourth and fifth path segment; short paths have none there
    t = tables(spark, sf).taxonomy
    parts = F.split("Level_5", "_")
    raw = t.select("entity", F.get(parts, 0).alias("Level_1"), F.get(parts, 3).alias("Level_2"),
                   F.get(parts, 4).alias("Level_3"))
    return C.label_paths(raw, LV)


def _points(spark, sf):
    t = tables(spark, sf)
    return t.entity_embeddings.join(t.taxonomy.select("entity", F.col("Level_1").alias("parent")), "entity")


@query("kmeans_nested")
def q_kmeans_nested(spark, sf):
    return C.kmeans_nested(_points(spark, sf), 3)


@query("kmeans_nested_imbalanced")
def q_kmeans_nested_imbalanced(spark, sf):
    return C.kmeans_nested(_points(spark, sf), 8, imbalanced=True)


@query("kmeans_nested_sizes", oracle=with_views("""
SELECT s.parent, s.n, CASE WHEN s.n >= 10 AND s.kp < s.n THEN s.kp END AS kp FROM (
  SELECT t.Level_1 AS parent, count(*) AS n, greatest(CAST(round(count(*) / (
    SELECT CAST(count(*) AS DOUBLE) FROM entity_embeddings JOIN taxonomy USING (entity)) * 8) AS INT), 2) AS kp
  FROM entity_embeddings e JOIN taxonomy t ON t.entity = e.entity GROUP BY t.Level_1) s""", "entity_embeddings", "taxonomy"))
def q_kmeans_nested_sizes(spark, sf):
    return C.nested_k(_points(spark, sf), 8, imbalanced=True)


@query("param_grid")
def q_param_grid(spark, sf):
    grid = C.param_grid({"k": [4, 8], "seed": [1, 2]})
    return C.kmeans_grid(_emb(spark, sf), {f"k={c['k']},seed={c['seed']}": (c["k"], c["seed"]) for c in grid})


@query("gmm_model_selection")
def q_gmm_model_selection(spark, sf):
    return C.gmm_model_selection(_emb(spark, sf), [2, 3, 4], [4, 8])


@query("embedding_sample", oracle=with_views(f"""
SELECT entity, label, round(embedding[1], 6) AS first FROM entity_embeddings
WHERE {unit_hash('entity', 5)} < 0.25E0 OR entity IN (SELECT entity FROM entity_groups)""", "entity_embeddings", "entity_groups"))
def q_embedding_sample(spark, sf):
    t = tables(spark, sf)
    s = C.embedding_sample(_emb(spark, sf), t.entity_groups, 0.25, seed=5)
    return s.select("entity", "label", r6(F.col("embedding")[0].cast("double")).alias("first"))


@query("kmeans_sample")
def q_kmeans_sample(spark, sf):
    """Clusters of a quarter of the embeddings, their number scaled with the sample."""
    t = tables(spark, sf)
    s = C.embedding_sample(_emb(spark, sf), t.entity_groups, 0.25, seed=5)
    return C.kmeans_flat(s, C.scaled_k(20, 0.25))


@query("embedding_noise", oracle=with_views(f"""
SELECT CAST(f.fraction AS DOUBLE) AS fraction, e.entity, e.label
FROM entity_embeddings e CROSS JOIN (VALUES {', '.join(f'({f}E0)' for f in FRACTIONS)}) f(fraction)
WHERE e.entity IN (SELECT entity FROM taxonomy) OR {unit_hash('e.entity', 0)} < f.fraction""", "entity_embeddings", "taxonomy"))
def q_embedding_noise(spark, sf):
    t = tables(spark, sf)
    emb = _emb(spark, sf)
    kept = emb.join(t.taxonomy.select("entity"), "entity", "left_semi")
    dropped = emb.join(t.taxonomy.select("entity"), "entity", "left_anti")
    return C.embedding_noise(kept, dropped, FRACTIONS).select("fraction", "entity", "label")


_CE = ", ".join(f"'ce' || CAST(CAST(split_part(Level_{i}, '_', -1) AS INT) * 7 + 3 AS STRING) AS Level_{i}" for i in (1, 2, 3))


@query("normalise_centroid_ids", oracle=with_views("""
SELECT r.entity,
  coalesce(nullif(l1, ''), '') AS Level_1,
  concat_ws('_', nullif(l1, ''), nullif(l2, '')) AS Level_2,
  concat_ws('_', nullif(l1, ''), nullif(l2, ''), nullif(l3, '')) AS Level_3
FROM (SELECT x.entity,
        CASE WHEN k1.k > 1 THEN CAST(k1.r AS STRING) ELSE '' END AS l1,
        CASE WHEN k2.k > 1 THEN CAST(k2.r AS STRING) ELSE '' END AS l2,
        CASE WHEN k3.k > 1 THEN CAST(k3.r AS STRING) ELSE '' END AS l3
      FROM raw x
      JOIN (SELECT a, dense_rank() OVER (ORDER BY a) - 1 AS r, count(*) OVER () AS k FROM (SELECT DISTINCT a FROM raw) u) k1 ON k1.a = x.a
      JOIN (SELECT a, b, dense_rank() OVER (PARTITION BY a ORDER BY b) - 1 AS r, count(*) OVER (PARTITION BY a) AS k
            FROM (SELECT DISTINCT a, b FROM raw) u) k2 ON k2.a = x.a AND k2.b = x.b
      JOIN (SELECT a, b, c, dense_rank() OVER (PARTITION BY a, b ORDER BY c) - 1 AS r, count(*) OVER (PARTITION BY a, b) AS k
            FROM (SELECT DISTINCT a, b, c FROM raw) u) k3 ON k3.a = x.a AND k3.b = x.b AND k3.c = x.c) r""",
    "taxonomy", extra={"raw": "SELECT entity, " + ", ".join(
        f"CAST(split_part(Level_{i}, '_', -1) AS INT) * 7 + 3 AS {v}" for i, v in ((1, 'a'), (2, 'b'), (4, 'c')))
        + " FROM taxonomy"}))
def q_normalise_centroid_ids(spark, sf):
    t = tables(spark, sf).taxonomy
    raw = t.select("entity", *[F.concat(F.lit("ce"), (F.element_at(F.split(f"Level_{i}", "_"), -1).cast("int") * 7 + 3)
                                        .cast("string")).alias(n) for i, n in ((1, "Level_1"), (2, "Level_2"), (4, "Level_3"))])
    return C.normalise_centroid_ids(raw, LV)
