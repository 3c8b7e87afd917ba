"""SQL text of the domain views, for the DuckDB oracle.

These are the statements documented in FIXTURES.md. The oracle inlines the
ones a query needs as CTEs (the driver registers only the base tables). The
Spark side builds the same views with the DataFrame API in
``landscape.sources.tables`` so that the two engines are checked against
each other, not against a shared string.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "taxonomy": """
SELECT entity, Level_1, Level_2, Level_3, Level_4,
  CASE WHEN p % 5 = 0 OR p % 7 = 0 THEN Level_4 ELSE Level_4 || '_' || CAST(CAST(floor(p / 72) AS BIGINT) % 2 AS STRING) END AS Level_5
FROM (SELECT p, entity, Level_1, Level_2, Level_3,
  CASE WHEN p % 5 = 0 THEN Level_3 ELSE Level_3 || '_' || CAST(CAST(floor(p / 36) AS BIGINT) % 2 AS STRING) END AS Level_4
FROM (SELECT p, entity, Level_1, Level_2, Level_2 || '_' || CAST(CAST(floor(p / 12) AS BIGINT) % 3 AS STRING) AS Level_3
FROM (SELECT p, entity, Level_1, Level_1 || '_' || CAST(CAST(floor(p / 4) AS BIGINT) % 3 AS STRING) AS Level_2
FROM (SELECT p_partkey AS p, 'e' || CAST(p_partkey AS STRING) AS entity, CAST(p_partkey % 4 AS STRING) AS Level_1
FROM part WHERE p_partkey % 11 <> 10) a) b) c) d""",
    "works": """
SELECT 'W' || CAST(o_orderkey AS STRING) AS work_id, 'Order ' || CAST(o_orderkey AS STRING) AS display_name,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INT) END AS publication_year,
  CAST(o_orderdate AS DATE) AS publication_date,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE n_name END AS venue_display_name,
  CAST((o_orderkey * 13) % 120 AS INT) AS cited_by_count
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus <> 'F'""",
    "patents": """
SELECT 'P' || CAST(o_orderkey AS STRING) AS publication_number, CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING) AS family_id,
  CAST(o_orderdate AS DATE) AS publication_date
FROM orders WHERE o_orderstatus = 'F'""",
    "doc_entities": """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'P' ELSE 'W' END || CAST(l_orderkey AS STRING) AS doc_id,
  CASE WHEN o_orderstatus = 'F' THEN 'patents' ELSE 'openalex' END AS source,
  CAST(l_linenumber AS INT) AS pos, 'e' || CAST(l_partkey AS STRING) AS entity,
  CAST(50 + 10 * (CAST(l_quantity AS INT) % 6) AS INT) AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "doc_orgs": """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'P' ELSE 'W' END || CAST(l_orderkey AS STRING) AS doc_id,
  s_name AS org, CASE WHEN l_suppkey % 5 = 0 THEN 'PERSON' ELSE 'ORGANISATION' END AS org_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "cd_scores": """
SELECT work_id, ((CAST(substr(work_id, 2) AS BIGINT) * 7919) % 2001 - 1000) / 1000.0E0 AS cd_score, publication_year AS year
FROM works WHERE publication_year BETWEEN 1994 AND 2000 AND CAST(substr(work_id, 2) AS BIGINT) % 3 <> 0""",
    "citations": """
SELECT DISTINCT 'W' || CAST(o_orderkey AS STRING) AS citing, 'W' || CAST(CAST(floor(o_orderkey / d) AS BIGINT) AS STRING) AS cited
FROM orders CROSS JOIN (SELECT 2 AS d UNION ALL SELECT 3 UNION ALL SELECT 4) k
WHERE o_orderkey >= 10""",
    "entity_embeddings": """
SELECT 'e' || CAST(vec_id AS STRING) AS entity, embedding, label FROM embeddings""",
    "entity_groups": """
SELECT CASE WHEN label % 2 = 0 THEN 'natural' ELSE 'social' END AS area, 'd' || CAST(label AS STRING) AS discipline, entity
FROM entity_embeddings JOIN taxonomy USING (entity) WHERE CAST(substr(entity, 2) AS BIGINT) < 120""",
    "topic_names": """
SELECT DISTINCT level, topic, 'Name ' || topic AS name FROM (
 SELECT 1 AS level, Level_1 AS topic FROM taxonomy UNION ALL SELECT 2, Level_2 FROM taxonomy UNION ALL SELECT 3, Level_3 FROM taxonomy) t
WHERE topic <> '3_2_1'""",
    # Derived views shared by many oracles (written independently of the
    # DataFrame code in landscape.operators).
    "docs": """
SELECT work_id AS doc_id, 'openalex' AS source, publication_year AS year, display_name AS title FROM works
UNION ALL
SELECT publication_number, 'patents', CAST(year(publication_date) AS INT), publication_number FROM patents""",
    "doc_topics": """
SELECT e.doc_id, e.source, l.level, l.topic
FROM doc_entities e JOIN (
  SELECT entity, 1 AS level, Level_1 AS topic FROM taxonomy UNION ALL
  SELECT entity, 2, Level_2 FROM taxonomy UNION ALL
  SELECT entity, 3, Level_3 FROM taxonomy UNION ALL
  SELECT entity, 4, Level_4 FROM taxonomy UNION ALL
  SELECT entity, 5, Level_5 FROM taxonomy) l ON e.entity = l.entity
WHERE e.confidence >= 80""",
}

DEPENDS: dict[str, tuple[str, ...]] = {
    "cd_scores": ("works",),
    "entity_groups": ("entity_embeddings", "taxonomy"),
    "topic_names": ("taxonomy",),
    "docs": ("works", "patents"),
    "doc_topics": ("doc_entities", "taxonomy"),
}

ORDER = list(VIEWS)


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies included).

    ``extra`` adds query-local CTEs (name -> SQL) after the shared views,
    in the given order.
    """
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        need.add(n)
        for d in DEPENDS.get(n, ()):
            add(d)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in ORDER if n in need]
    for n, sql in (extra or {}).items():
        ctes.append(f"{n} AS ({sql.strip()})")
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
