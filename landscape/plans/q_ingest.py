"""Registered source, sink and normalisation queries (2.A / 2.B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as IG
from ..session import scratch_path
from ..sources import nested
from .q_novelty import _topics
from .registry import joined, query, r6, tables
from .sqlhelp import unit_hash
from .views_sql import with_views

WL = """SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.s_name, n.n_name
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE o.o_orderstatus <> 'F'"""


def _raw_works(spark, sf):
    t = tables(spark, sf)
    return t.stage("raw_works", lambda: nested.raw_works(t))


def _raw_patents(spark, sf):
    t = tables(spark, sf)
    return t.stage("raw_patents", lambda: nested.raw_patents(t))


@query("work_metadata", oracle=with_views("""
SELECT work_id, '10.1/' || work_id AS doi, display_name, publication_year, CAST(publication_date AS STRING) AS publication_date,
  cited_by_count, CAST(substr(work_id, 2) AS BIGINT) % 101 = 0 AS is_retracted,
  CASE WHEN venue_display_name IS NOT NULL THEN 'V' || venue_display_name END AS venue_id, venue_display_name,
  CAST(NULL AS STRING) AS venue_url
FROM works""", "works"))
def q_work_metadata(spark, sf):
    return IG.work_metadata(_raw_works(spark, sf))


@query("work_concepts", oracle=with_views("""
SELECT doc_id, entity AS id, entity AS display_name, CAST(CAST(confidence / 100.0E0 AS STRING) AS DOUBLE) AS score
FROM doc_entities WHERE source = 'openalex' AND doc_id IN (SELECT work_id FROM works)""", "doc_entities", "works"))
def q_work_concepts(spark, sf):
    return IG.work_concepts(_raw_works(spark, sf))


@query("work_authorships", oracle=with_views(f"""
SELECT 'W' || CAST(l_orderkey AS STRING) AS id, 'A' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS auth_id,
  s_name AS auth_display_name, CAST(NULL AS STRING) AS auth_orcid, s_name AS affiliation_string,
  'I' || CAST(l_suppkey AS STRING) AS inst_id
FROM ({WL}) w WHERE (l_orderkey + l_linenumber) % 7 <> 0"""))
def q_work_authorships(spark, sf):
    return IG.work_authorships(_raw_works(spark, sf))


@query("institution_metadata", oracle=with_views(f"""
SELECT DISTINCT 'I' || CAST(l_suppkey AS STRING) AS id, s_name AS display_name, n_name AS country_code, 'education' AS type
FROM ({WL}) w WHERE (l_orderkey + l_linenumber) % 7 <> 0"""))
def q_institution_metadata(spark, sf):
    return IG.institution_metadata(_raw_works(spark, sf))


@query("work_citations", oracle=with_views(
    "SELECT citing, cited FROM citations WHERE citing IN (SELECT work_id FROM works)", "citations", "works"))
def q_work_citations(spark, sf):
    return IG.work_citations(_raw_works(spark, sf))


@query("deinvert_abstract", oracle="SELECT doc_id AS id, text AS abstract FROM documents")
def q_deinvert_abstract(spark, sf):
    docs = tables(spark, sf).documents
    inv = IG.invert_abstract(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    return IG.deinvert_abstract(inv)


@query("reformat_entities", oracle=with_views("""
SELECT d.doc_id, coalesce(e.entities, '') AS entities FROM (SELECT DISTINCT doc_id FROM doc_entities) d
LEFT JOIN (SELECT doc_id, string_agg(entity || ' ' || source, ',' ORDER BY entity || ' ' || source) AS entities
           FROM doc_entities WHERE confidence >= 70 GROUP BY doc_id) e ON d.doc_id = e.doc_id""", "doc_entities"))
def q_reformat_entities(spark, sf):
    out = IG.reformat_entities(nested.annotations(tables(spark, sf)), 70)
    return out.select("doc_id", joined("entities").alias("entities"))


@query("annotation_lookup", oracle="""
SELECT 'P' || CAST(o_orderkey AS STRING) AS id, 'Abstract ' || CAST(o_orderkey AS STRING) || 'second line' AS abstract
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0""")
def q_annotation_lookup(spark, sf):
    txt = IG.english_text(_raw_patents(spark, sf)).where(F.col("abstract").isNotNull())
    return IG.annotation_lookup(txt, "publication_number", "abstract")


@query("annotation_lookup_works", oracle="SELECT doc_id AS id, replace(text, chr(10), '') AS abstract FROM documents")
def q_annotation_lookup_works(spark, sf):
    """Works: their abstracts, rebuilt from inverted indexes."""
    inv = IG.invert_abstract(tables(spark, sf).documents, "doc_id", "text").withColumnRenamed("doc_id", "id")
    return IG.annotation_lookup(IG.deinvert_abstract(inv), "id", "abstract")


@query("patent_dates", oracle="""
SELECT 'P' || CAST(o_orderkey AS STRING) AS publication_number, CAST(CAST(o_orderdate AS DATE) AS STRING) AS publication_date,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) - 200 AS STRING) END AS filing_date,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + 100 AS STRING) END AS grant_date,
  CAST(NULL AS STRING) AS priority_date
FROM orders WHERE o_orderstatus = 'F'""")
def q_patent_dates(spark, sf):
    d = IG.patent_dates(_raw_patents(spark, sf))  # dates, emitted as ISO strings
    return d.select("publication_number", *[F.col(c).cast("string").alias(c) for c in d.columns[1:]])


@query("english_text", oracle="""
SELECT 'P' || CAST(o_orderkey AS STRING) AS publication_number, 'Patent ' || CAST(o_orderkey AS STRING) AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Abstract ' || CAST(o_orderkey AS STRING) || chr(10) || 'second line' END AS abstract
FROM orders WHERE o_orderstatus = 'F'""")
def q_english_text(spark, sf):
    return IG.english_text(_raw_patents(spark, sf))


@query("cpc_codes", oracle="""
SELECT 'P' || CAST(o_orderkey AS STRING) AS publication_number,
  'A0' || CAST(o_orderkey % 10 AS STRING) || ',B' || CAST(o_orderkey % 7 AS STRING) AS cpc_codes
FROM orders WHERE o_orderstatus = 'F'""")
def q_cpc_codes(spark, sf):
    return IG.cpc_codes(_raw_patents(spark, sf)).select("publication_number", F.array_join("cpc_codes", ",").alias("cpc_codes"))


PL = """SELECT o.o_orderkey, l.l_linenumber, l.l_suppkey, s.s_name,
  CASE WHEN s.s_nationkey % 3 = 0 THEN 'GB' ELSE substr(n.n_name, 1, 2) END AS cc
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE o.o_orderstatus = 'F'"""


@query("assignee_types", oracle=f"""
SELECT 'P' || CAST(a.o_orderkey AS STRING) AS publication_number,
  string_agg(a.s_name || ':' || CASE WHEN EXISTS (SELECT 1 FROM ({PL}) i WHERE i.o_orderkey = a.o_orderkey
       AND i.l_suppkey % 5 = 0 AND i.s_name = a.s_name) THEN 'PERSON' ELSE 'ORGANISATION' END, ','
       ORDER BY a.l_linenumber, a.s_name, a.cc) AS typed
FROM ({PL}) a GROUP BY a.o_orderkey""")
def q_assignee_types(spark, sf):
    t = IG.assignee_types(IG.unnest_parties(_raw_patents(spark, sf)))
    t = t.where(F.size("assignee_harmonized_names") > 0)
    pairs = F.transform(F.arrays_zip("assignee_harmonized_names", "assignee_types"),
                        lambda z: F.concat_ws(":", z["assignee_harmonized_names"], z["assignee_types"]))
    return t.select("publication_number", F.array_join(pairs, ",").alias("typed"))


@query("patent_org_rows", oracle=f"""
SELECT 'P' || CAST(a.o_orderkey AS STRING) AS publication_number, a.s_name AS org, 'ORGANISATION' AS org_type
FROM ({PL}) a WHERE NOT EXISTS (SELECT 1 FROM ({PL}) i WHERE i.o_orderkey = a.o_orderkey AND i.l_suppkey % 5 = 0
                                AND i.s_name = a.s_name)""")
def q_patent_org_rows(spark, sf):
    return IG.patent_org_rows(IG.assignee_types(IG.unnest_parties(_raw_patents(spark, sf))))


@query("unnest_parties", oracle=f"""
SELECT 'P' || CAST(o_orderkey AS STRING) AS publication_number,
  string_agg(CASE WHEN l_suppkey % 5 = 0 THEN s_name END, ',' ORDER BY l_linenumber, s_name, cc) AS inventors,
  string_agg(s_name || '/' || cc, ',' ORDER BY l_linenumber, s_name, cc) AS assignees
FROM ({PL}) p GROUP BY o_orderkey""")
def q_unnest_parties(spark, sf):
    p = IG.unnest_parties(_raw_patents(spark, sf)).where(F.size("assignee_harmonized_names") > 0)
    asg = F.transform(F.arrays_zip("assignee_harmonized_names", "assignee_harmonized_country_codes"),
                      lambda z: F.concat_ws("/", z["assignee_harmonized_names"], z["assignee_harmonized_country_codes"]))
    inv = F.when(F.size("inventor_harmonized_names") > 0, F.array_join("inventor_harmonized_names", ","))
    return p.select("publication_number", inv.alias("inventors"), F.array_join(asg, ",").alias("assignees"))


@query("patent_family_extract", oracle=f"""
WITH ok AS (
  SELECT 'P' || CAST(o_orderkey AS STRING) AS publication_number, CAST(floor(o_orderkey / 3) AS BIGINT) AS fam
  FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 0
    AND CAST(o_orderdate AS DATE) - 200 BETWEEN DATE '1990-01-01' AND DATE '2022-12-31'
    AND o_orderkey IN (SELECT o_orderkey FROM ({PL}) p WHERE l_suppkey % 5 = 0 AND cc = 'GB'))
SELECT CAST(f.fam AS STRING) AS family_id, f.p AS publication_number, 'Patent ' || substr(f.p, 2) AS title,
  'Abstract ' || substr(f.p, 2) || chr(10) || 'second line' AS abstract,
  'A0' || CAST(o_orderkey % 10 AS STRING) || ',B' || CAST(o_orderkey % 7 AS STRING) AS cpc_codes,
  (SELECT string_agg(DISTINCT cc, ',' ORDER BY cc) FROM ({PL}) p WHERE p.o_orderkey = o.o_orderkey AND l_suppkey % 5 = 0) AS inventor_countries,
  (SELECT count(*) FROM ({PL}) p WHERE p.o_orderkey = o.o_orderkey) AS n_assignees,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS publication_date, CAST(CAST(o_orderdate AS DATE) - 200 AS STRING) AS filing_date,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + 100 AS STRING) END AS grant_date,
  CAST(NULL AS STRING) AS priority_date
FROM (SELECT fam, min(publication_number) AS p FROM ok GROUP BY fam) f JOIN orders o ON 'P' || CAST(o.o_orderkey AS STRING) = f.p""")
def q_patent_family_extract(spark, sf):
    out = IG.patent_family_extract(IG.patent_records(_raw_patents(spark, sf)), start="1990-01-01")
    codes = F.array_join(F.array_sort(F.array_distinct("inventor_harmonized_country_codes")), ",")
    return out.select("family_id", "publication_number", "title", "abstract", F.array_join("cpc_codes", ",").alias("cpc_codes"),
                      codes.alias("inventor_countries"), F.size("assignee_harmonized_names").cast("long").alias("n_assignees"),
                      *[F.col(c).cast("string").alias(c) for c in ("publication_date", "filing_date", "grant_date", "priority_date")])


@query("topics_long", oracle=with_views(
    "SELECT doc_id AS id, topic FROM doc_topics WHERE level = 3", "doc_topics"))
def q_topics_long(spark, sf):
    lists = (_topics(spark, sf).where(F.col("level") == 3)
             .groupBy("doc_id").agg(F.collect_list("topic").alias("topics")))
    return IG.topics_long(lists)


@query("concat_yearly_parts", oracle=with_views("""
SELECT doc_id, entity, year FROM (
  SELECT e.doc_id, e.entity, d.year, row_number() OVER (PARTITION BY e.entity ORDER BY d.year DESC, e.doc_id DESC) AS rn
  FROM doc_entities e JOIN docs d ON e.doc_id = d.doc_id WHERE d.year IS NOT NULL) x WHERE rn = 1""", "doc_entities", "docs"))
def q_concat_yearly_parts(spark, sf):
    # per-year parts keyed by entity: the latest year's row wins (ties: larger doc id)
    t = tables(spark, sf)
    parts = (t.doc_entities.join(t.docs.select("doc_id", "year"), "doc_id").where(F.col("year").isNotNull())
             .select("doc_id", "entity", "year"))
    path = scratch_path(spark, "mentions_by_year")
    IG.write_by_year(parts, path)
    back = spark.read.parquet(path).select("doc_id", "entity", F.col("year").cast("int").alias("year"))
    return IG.concat_yearly_parts(back, "entity", ties=["doc_id"])


@query("union_yearly_cd_scores", oracle=with_views(
    "SELECT work_id, round(cd_score, 6) AS cd_score, year FROM cd_scores", "cd_scores"))
def q_union_yearly_cd_scores(spark, sf):
    path = scratch_path(spark, "cd_scores_by_year")
    IG.write_by_year(tables(spark, sf).cd_scores, path)
    back = spark.read.parquet(path)  # year comes back as the partition column
    return back.select("work_id", r6("cd_score").alias("cd_score"), F.col("year").cast("int").alias("year"))


READ_WORKS_SQL = with_views("""
SELECT w.work_id AS id, '10.1/' || w.work_id AS doi, w.display_name, w.publication_year, CAST(w.publication_date AS STRING) AS publication_date,
  w.venue_display_name AS venue, w.cited_by_count, CAST(substr(w.work_id, 2) AS BIGINT) % 101 = 0 AS is_retracted,
  coalesce(c.n, 0) AS n_concepts, coalesce(r.n, 0) AS n_references
FROM works w LEFT JOIN (SELECT doc_id, count(*) AS n FROM doc_entities WHERE source = 'openalex' GROUP BY doc_id) c ON c.doc_id = w.work_id
LEFT JOIN (SELECT citing, count(*) AS n FROM citations GROUP BY citing) r ON r.citing = w.work_id""",
                            "works", "doc_entities", "citations")


def _read_back(raw):
    return raw.select("id", "doi", "display_name", "publication_year", "publication_date",
                      F.col("host_venue.display_name").alias("venue"), "cited_by_count", "is_retracted",
                      F.coalesce(F.size("concepts"), F.lit(0)).cast("long").alias("n_concepts"),
                      F.coalesce(F.size("referenced_works"), F.lit(0)).cast("long").alias("n_references"))


@query("read_works_json", oracle=READ_WORKS_SQL)
def q_read_works_json(spark, sf):
    path = scratch_path(spark, "works_json")
    nested.write_json_lines(_raw_works(spark, sf), path)
    return _read_back(IG.read_works_json(spark, path, multi_line=False))


@query("read_works_arrays", oracle=READ_WORKS_SQL)
def q_read_works_arrays(spark, sf):
    """Yearly files, each an indented array."""
    path = scratch_path(spark, "works_arrays")
    nested.write_json_arrays(_raw_works(spark, sf), path, "publication_year", "gzip")
    return _read_back(IG.read_works_json(spark, path))


@query("citation_request_batches", oracle=with_views("""
SELECT CAST(floor((rn - 1) / 50) AS BIGINT) AS batch, string_agg(id, '|' ORDER BY id) AS ids, count(*) AS n_ids,
  CAST(floor(floor((rn - 1) / 50) / 350) AS BIGINT) AS chunk
FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (
  SELECT work_id AS id FROM works WHERE cited_by_count >= 60
  UNION SELECT c.cited FROM citations c JOIN works w ON c.citing = w.work_id WHERE w.cited_by_count >= 60) u) x
GROUP BY floor((rn - 1) / 50)""", "works", "citations"))
def q_citation_request_batches(spark, sf):
    t = tables(spark, sf)
    return IG.citation_request_batches(t.works, t.citations, min_citations=60, with_references=True)


def _pages(spark, sf):
    """Response pages: works in id order, 50 per page, as JSON text."""
    from ..functions.ordering import global_row_number
    raw = _raw_works(spark, sf).select("id", F.coalesce("referenced_works", F.array().cast("array<string>")).alias("referenced_works"))
    n = global_row_number(raw, ["id"]).withColumn("page", F.floor((F.col("rn") - 1) / 50).cast("int"))
    pages = n.groupBy("page").agg(F.collect_list(F.struct("id", "referenced_works")).alias("results"),
                                  F.count("*").alias("count"))
    return pages.select(F.to_json(F.struct(F.struct("count", "page").alias("meta"), "results")).alias("json"))


@query("parse_forward_citations", oracle=with_views(
    "SELECT citing, cited FROM citations WHERE citing IN (SELECT work_id FROM works)", "citations", "works"))
def q_parse_forward_citations(spark, sf):
    return IG.parse_forward_citations(_pages(spark, sf))


@query("patent_count_probe", oracle=f"""
WITH pl AS ({PL}), base AS (
  SELECT 'P' || CAST(o.o_orderkey AS STRING) AS pub, CAST(CAST(floor(o.o_orderkey / 3) AS BIGINT) AS STRING) AS fam,
    o.o_orderkey % 4 <> 0 AS en,
    EXISTS (SELECT 1 FROM pl WHERE pl.o_orderkey = o.o_orderkey AND pl.l_suppkey % 5 = 0 AND pl.cc = 'GB') AS inv,
    EXISTS (SELECT 1 FROM pl WHERE pl.o_orderkey = o.o_orderkey AND pl.cc = 'GB') AS asg
  FROM orders o WHERE o.o_orderstatus = 'F')
SELECT v.variant, e.english_only,
  count(DISTINCT CASE WHEN (CASE v.variant WHEN 'inventor' THEN inv WHEN 'assignee' THEN asg ELSE inv OR asg END)
                       AND (en OR NOT e.english_only) THEN pub END) AS n_publications,
  count(DISTINCT CASE WHEN (CASE v.variant WHEN 'inventor' THEN inv WHEN 'assignee' THEN asg ELSE inv OR asg END)
                       AND (en OR NOT e.english_only) THEN fam END) AS n_families
FROM base CROSS JOIN (VALUES ('inventor'), ('assignee'), ('inventor_or_assignee')) v(variant)
CROSS JOIN (VALUES (false), (true)) e(english_only)
GROUP BY v.variant, e.english_only""")
def q_patent_count_probe(spark, sf):
    raw = _raw_patents(spark, sf)
    return IG.patent_count_probe(raw.select("publication_number", "family_id"), IG.unnest_parties(raw),
                                 IG.english_text(raw))


@query("patent_count_probe_filed", oracle=f"""
WITH pl AS ({PL}), base AS (
  SELECT 'P' || CAST(o.o_orderkey AS STRING) AS pub, CAST(CAST(floor(o.o_orderkey / 3) AS BIGINT) AS STRING) AS fam,
    o.o_orderkey % 4 <> 0 AS en,
    EXISTS (SELECT 1 FROM pl WHERE pl.o_orderkey = o.o_orderkey AND pl.l_suppkey % 5 = 0 AND pl.cc = 'GB') AS inv,
    EXISTS (SELECT 1 FROM pl WHERE pl.o_orderkey = o.o_orderkey AND pl.cc = 'GB') AS asg
  FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_orderkey % 10 <> 0
    AND CAST(o.o_orderdate AS DATE) - 200 BETWEEN DATE '1993-01-01' AND DATE '1994-06-30')
SELECT v.variant, e.english_only,
  count(DISTINCT CASE WHEN (CASE v.variant WHEN 'inventor' THEN inv WHEN 'assignee' THEN asg ELSE inv OR asg END)
                       AND (en OR NOT e.english_only) THEN pub END) AS n_publications,
  count(DISTINCT CASE WHEN (CASE v.variant WHEN 'inventor' THEN inv WHEN 'assignee' THEN asg ELSE inv OR asg END)
                       AND (en OR NOT e.english_only) THEN fam END) AS n_families
FROM base CROSS JOIN (VALUES ('inventor'), ('assignee'), ('inventor_or_assignee')) v(variant)
CROSS JOIN (VALUES (false), (true)) e(english_only)
GROUP BY v.variant, e.english_only""")
def q_patent_count_probe_filed(spark, sf):
    raw = _raw_patents(spark, sf)
    dated = IG.patent_dates(raw).join(raw.select("publication_number", "family_id"), "publication_number")
    return IG.patent_count_probe(dated, IG.unnest_parties(raw), IG.english_text(raw), filed=("1993-01-01", "1994-06-30"))


@query("write_by_year", oracle=with_views(
    "SELECT work_id, display_name, cited_by_count, publication_year FROM works", "works"))
def q_write_by_year(spark, sf):
    path = scratch_path(spark, "works_by_year")
    w = tables(spark, sf).works.select("work_id", "display_name", "cited_by_count",
                                       F.col("publication_year").alias("year"))
    IG.write_by_year(w, path)
    back = spark.read.parquet(path)  # NULL years come back from the default partition
    return back.select("work_id", "display_name", "cited_by_count", F.col("year").cast("int").alias("publication_year"))


@query("validation_sample", oracle=with_views(f"""
SELECT e.doc_id AS id, e.entity, e.confidence, e.source,
  CASE WHEN CAST(substr(e.doc_id, 2) AS BIGINT) % 4 <> 0
       THEN 'Abstract ' || substr(e.doc_id, 2) || chr(10) || 'second line' END AS abstract
FROM doc_entities e JOIN (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM doc_entities WHERE source = 'patents') d
  ORDER BY {unit_hash('doc_id', 3)}, doc_id LIMIT 100) s ON s.doc_id = e.doc_id""", "doc_entities"))
def q_validation_sample(spark, sf):
    """100 patents with mentions in seeded-hash order, their mentions and abstract."""
    from ..functions.sampling import unit_hash
    t = tables(spark, sf)
    docs = (t.doc_entities.where(F.col("source") == "patents").select("doc_id").distinct()
            .orderBy(unit_hash("doc_id", 3), "doc_id").limit(100))
    text = IG.english_text(_raw_patents(spark, sf)).select(F.col("publication_number").alias("doc_id"), "abstract")
    return (t.doc_entities.join(docs, "doc_id", "left_semi")
            .join(text, "doc_id", "left")
            .select(F.col("doc_id").alias("id"), "entity", "confidence", "source", "abstract"))


@query("invert_abstract", oracle="""
SELECT doc_id, word, string_agg(CAST(pos AS STRING), ',' ORDER BY pos) AS positions FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS pos
  FROM documents) w
GROUP BY doc_id, word""")
def q_invert_abstract(spark, sf):
    inv = IG.invert_abstract(tables(spark, sf).documents, "doc_id", "text")
    return inv.select("doc_id", F.explode("abstract_inverted_index").alias("word", "p")).select(
        "doc_id", "word", F.array_join("p", ",").alias("positions"))
