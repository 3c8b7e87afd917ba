"""Registered taxonomy edits (2.J) with literal edit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as ED
from .registry import query, tables
from .views_sql import with_views

# Fixed edit lists (curated values, stated plainly).
DISCARD = ["e1", "e2", "e3", "e25", "e100"]
RENAMES = [("0", "Renamed domain 0"), ("1_2", "Renamed area 1_2")]
MOVES = [("e7", "3", "3_0", "3_0_0"), ("e8", "3", "3_0", "3_0_1")]
DROPS = [(2, "2_1"), (1, "0")]
MOVE_DOMAINS = ["3"]


def _lit(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _vals(rows) -> str:
    def q(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


@query("tax_discard", oracle=with_views(
    f"SELECT * FROM taxonomy WHERE entity NOT IN ({', '.join(repr(e) for e in DISCARD)}) AND NOT regexp_matches(entity, '\\(film\\)')",
    "taxonomy"))
def q_tax_discard(spark, sf):
    d = _lit(spark, [(e,) for e in DISCARD], "entity string")
    return ED.tax_discard(tables(spark, sf).taxonomy, d)


@query("tax_discard_all", oracle=with_views(f"""
SELECT * FROM taxonomy WHERE entity NOT IN ({', '.join(repr(e) for e in DISCARD)}) AND NOT regexp_matches(entity, '\\(film\\)')
  AND entity NOT IN (SELECT entity FROM doc_entities GROUP BY entity HAVING max(confidence) < 90)
  AND entity IN (SELECT entity FROM doc_entities WHERE confidence >= 80)""", "taxonomy", "doc_entities"))
def q_tax_discard_all(spark, sf):
    """Listed and flagged entities (never confident) out, confidently mentioned ones kept."""
    t = tables(spark, sf)
    flagged = t.doc_entities.groupBy("entity").agg(F.max("confidence").alias("c")).where("c < 90")
    kept = t.doc_entities.where("confidence >= 80").select("entity").distinct()
    return ED.tax_discard(t.taxonomy, _lit(spark, [(e,) for e in DISCARD], "entity string"), flagged=flagged, preprocessed=kept)


@query("tax_rename", oracle=with_views(f"""
SELECT n.level, n.topic, coalesce(r.new_name, n.name) AS name FROM topic_names n
LEFT JOIN (VALUES {_vals(RENAMES)}) r(topic, new_name) ON n.topic = r.topic""", "topic_names"))
def q_tax_rename(spark, sf):
    return ED.tax_rename(tables(spark, sf).topic_names, _lit(spark, RENAMES, "topic string, new_name string"))


@query("tax_move_entities", oracle=with_views(f"""
SELECT t.entity, coalesce(m.l1, t.Level_1) AS Level_1, coalesce(m.l2, t.Level_2) AS Level_2,
  coalesce(m.l3, t.Level_3) AS Level_3, coalesce(m.l3, t.Level_4) AS Level_4, coalesce(m.l3, t.Level_5) AS Level_5
FROM taxonomy t LEFT JOIN (VALUES {_vals(MOVES)}) m(entity, l1, l2, l3) ON t.entity = m.entity""", "taxonomy"))
def q_tax_move_entities(spark, sf):
    m = _lit(spark, MOVES, "entity string, Level_1 string, Level_2 string, Level_3 string")
    return ED.tax_move_entities(tables(spark, sf).taxonomy, m)


@query("tax_drop_topics", oracle=with_views(
    "SELECT * FROM taxonomy WHERE Level_2 <> '2_1' AND Level_1 <> '0'", "taxonomy"))
def q_tax_drop_topics(spark, sf):
    return ED.tax_drop_topics(tables(spark, sf).taxonomy, _lit(spark, DROPS, "level int, topic string"))


@query("tax_move_areas", oracle=with_views("""
SELECT entity, CASE WHEN Level_1 = '3' THEN '26' ELSE Level_1 END AS Level_1,
  CASE WHEN Level_1 = '3' THEN '26_' || Level_1 ELSE Level_2 END AS Level_2,
  CASE WHEN Level_1 = '3' THEN '26_' || Level_2 ELSE Level_3 END AS Level_3,
  CASE WHEN Level_1 = '3' THEN '26_' || Level_3 ELSE Level_4 END AS Level_4,
  CASE WHEN Level_1 = '3' THEN '26_' || Level_4 ELSE Level_5 END AS Level_5 FROM taxonomy""", "taxonomy"))
def q_tax_move_areas(spark, sf):
    return ED.tax_move_areas(tables(spark, sf).taxonomy, MOVE_DOMAINS)


@query("preprune_entities", oracle=with_views("""
SELECT DISTINCT entity FROM doc_entities WHERE entity NOT IN (
  SELECT entity FROM (SELECT DISTINCT entity FROM doc_entities WHERE confidence = 50) f
  WHERE entity NOT IN ('e10', 'e11'))""", "doc_entities"))
def q_preprune_entities(spark, sf):
    de = tables(spark, sf).doc_entities
    ents = de.select("entity").distinct()
    flagged = de.where(F.col("confidence") == 50).select("entity").distinct()  # flagged: ever at the lowest score
    keep = _lit(spark, [("e10",), ("e11",)], "entity string")
    return ED.preprune_entities(ents, flagged, keep)


@query("tax_finalise", oracle=with_views("""
SELECT entity, Level_1, Level_2, Level_3, Level_4, Level_5 FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS rn FROM (
    SELECT *, 0 AS seq FROM taxonomy UNION ALL
    SELECT entity, '26' AS Level_1, '26_' || Level_1, '26_' || Level_2, '26_' || Level_3, '26_' || Level_4, 1 FROM taxonomy
    WHERE Level_1 = '3') u) x WHERE rn = 1""", "taxonomy"))
def q_tax_finalise(spark, sf):
    t = tables(spark, sf)
    base = t.taxonomy.withColumn("seq", F.lit(0))
    moved = ED.tax_move_areas(t.taxonomy.where(F.col("Level_1") == "3"), MOVE_DOMAINS).withColumn("seq", F.lit(1))
    tax, _names = ED.tax_finalise(base.unionByName(moved), t.topic_names)
    return tax


# -- country branch, merges, splits ---------------------------------------------------
# Fixed edit lists for the country branch (curated values).
ENTITY_REASSIGN = [("e5", "e6")]
COUNTRY_REMOVE = ["ALGERIA"]
COUNTRY_REASSIGN = [("UNITED STATES", "UNITED STATES OF AMERICA")]
REGION_CONTINENT = [("AFRICA", "Africa"), ("AMERICA", "North America, Central America, and Caribbean"),
                    ("ASIA", "Asia and Middle East"), ("EUROPE", "Europe"), ("MIDDLE EAST", "Asia and Middle East")]
MERGES = [("2", "1", 0), ("0_0", "0_1", 1), ("0_2", "0_1", 2)]
SPLITS = [("3_1", 0, "e7"), ("3_1", 0, "e19"), ("3_1", 1, "e23")]

TAGS_SQL = """SELECT DISTINCT w.venue_display_name AS country, e.entity FROM doc_entities e JOIN works w ON e.doc_id = w.work_id
WHERE e.confidence = 100 AND w.venue_display_name IS NOT NULL"""
CONT_SQL = f"""SELECT n.n_name AS country, c.continent FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN (VALUES {_vals(REGION_CONTINENT)}) c(region, continent) ON r.r_name = c.region"""
CTAGS_SQL = f"""SELECT DISTINCT coalesce(cr.new_country, t.country) AS country, t.entity, ct.continent FROM (
  SELECT t0.country, coalesce(er.new_entity, t0.entity) AS entity FROM tags t0
  LEFT JOIN (VALUES {_vals(ENTITY_REASSIGN)}) er(entity, new_entity) ON t0.entity = er.entity) t
LEFT JOIN (VALUES {_vals(COUNTRY_REASSIGN)}) cr(country, new_country) ON t.country = cr.country
LEFT JOIN cont ct ON ct.country = coalesce(cr.new_country, t.country)
WHERE t.country NOT IN ({', '.join(repr(c) for c in COUNTRY_REMOVE)})"""


def _country_tags(spark, sf):
    t = tables(spark, sf)
    w = t.works.where(F.col("venue_display_name").isNotNull())
    tags = (t.doc_entities.where(F.col("confidence") == 100)
            .join(w.select(F.col("work_id").alias("doc_id"), F.col("venue_display_name").alias("country")), "doc_id")
            .select("country", "entity").distinct())
    cont = (t.nation.join(t.region, t.nation.n_regionkey == t.region.r_regionkey)
            .join(F.broadcast(_lit(spark, REGION_CONTINENT, "r_name string, continent string")), "r_name")
            .select(F.col("n_name").alias("country"), "continent"))
    return ED.country_tags(tags, _lit(spark, ENTITY_REASSIGN, "entity string, new_entity string"),
                           _lit(spark, [(c,) for c in COUNTRY_REMOVE], "country string"),
                           _lit(spark, COUNTRY_REASSIGN, "country string, new_country string"), cont)


@query("country_tags", oracle=with_views("SELECT country, entity, continent FROM ctags", "doc_entities", "works",
                                         extra={"tags": TAGS_SQL, "cont": CONT_SQL, "ctags": CTAGS_SQL}))
def q_country_tags(spark, sf):
    return _country_tags(spark, sf)


_L2 = "CASE " + " ".join(f"WHEN continent = '{c}' THEN '25_{i}'" for i, c in enumerate(ED.CONTINENTS)) + " ELSE '25_7' END"


@query("tax_add_country_branch", oracle=with_views(f"""
SELECT entity, '25' AS Level_1, Level_2, Level_2 || '_' || CAST(i AS STRING) AS Level_3,
  Level_2 || '_' || CAST(i AS STRING) AS Level_4, Level_2 || '_' || CAST(i AS STRING) AS Level_5
FROM (SELECT t.*, dense_rank() OVER (PARTITION BY Level_2 ORDER BY country) - 1 AS i,
             row_number() OVER (PARTITION BY entity ORDER BY country) AS rn
      FROM (SELECT *, {_L2} AS Level_2 FROM ctags) t) x WHERE rn = 1""", "doc_entities", "works",
    extra={"tags": TAGS_SQL, "cont": CONT_SQL, "ctags": CTAGS_SQL}))
def q_tax_add_country_branch(spark, sf):
    return ED.tax_add_country_branch(_country_tags(spark, sf))


@query("tax_merge_topics", oracle=with_views("""
SELECT t.entity,
  CASE WHEN d.topic IS NOT NULL THEN d.target WHEN a.topic IS NOT NULL THEN split_part(a.target, '_', 1) ELSE t.Level_1 END AS Level_1,
  CASE WHEN d.topic IS NOT NULL THEN d.new WHEN a.topic IS NOT NULL THEN a.target ELSE t.Level_2 END AS Level_2,
  CASE WHEN d.topic IS NOT NULL THEN d.new || '_0' WHEN a.topic IS NOT NULL THEN a.new ELSE t.Level_3 END AS Level_3,
  CASE WHEN d.topic IS NOT NULL THEN d.new || '_0' WHEN a.topic IS NOT NULL THEN a.new ELSE t.Level_4 END AS Level_4,
  CASE WHEN d.topic IS NOT NULL THEN d.new || '_0' WHEN a.topic IS NOT NULL THEN a.new ELSE t.Level_5 END AS Level_5
FROM taxonomy t
LEFT JOIN (SELECT m.topic, m.target, m.target || '_' || CAST(coalesce(x.mx, -1) + row_number() OVER (PARTITION BY m.target ORDER BY m.seq) AS STRING) AS new
           FROM mg m LEFT JOIN (SELECT Level_1 AS p, max(CAST(split_part(Level_2, '_', -1) AS INT)) AS mx FROM taxonomy GROUP BY Level_1) x
           ON x.p = m.target WHERE strpos(m.target, '_') = 0) d ON t.Level_1 = d.topic
LEFT JOIN (SELECT m.topic, m.target, m.target || '_' || CAST(coalesce(x.mx, -1) + row_number() OVER (PARTITION BY m.target ORDER BY m.seq) AS STRING) AS new
           FROM mg m LEFT JOIN (SELECT Level_2 AS p, max(CAST(split_part(Level_3, '_', -1) AS INT)) AS mx FROM taxonomy GROUP BY Level_2) x
           ON x.p = m.target WHERE strpos(m.target, '_') > 0) a ON t.Level_2 = a.topic""", "taxonomy",
    extra={"mg": f"SELECT * FROM (VALUES {_vals(MERGES)}) v(topic, target, seq)"}))
def q_tax_merge_topics(spark, sf):
    m = _lit(spark, MERGES, "topic string, target string, seq int")
    return ED.tax_merge_topics(tables(spark, sf).taxonomy, m)


#: a domain goes under another, its new area under an area, then the domain that holds them moves; targets gone come back
CHAIN = [("2", "1", 0), ("0_0", "0_1", 1), ("0_1", "1_0", 2), ("0_2", "0_1", 3), ("1", "3", 4), ("4", "1", 5), ("3_0", "3_1", 6)]


def _replay_sql(edits):
    """One step after the other over the whole taxonomy."""
    steps, last = [], "taxonomy"
    for i, (topic, target, _) in enumerate(edits):
        own, kid = ("Level_1", "Level_2") if "_" not in target else ("Level_2", "Level_3")
        new = f"(SELECT '{target}_' || CAST(coalesce(max(CAST(split_part({kid}, '_', -1) AS INT)), -1) + 1 AS STRING) FROM {last} WHERE {own} = '{target}')"
        hit = f"{'Level_1' if '_' not in topic else 'Level_2'} = '{topic}'"
        cols = ([f"'{target}'", new] + [f"{new} || '_0'"] * 3) if own == "Level_1" else (
            [f"'{target.split('_')[0]}'", f"'{target}'"] + [new] * 3)
        steps.append(f"s{i} AS MATERIALIZED (SELECT entity, " + ", ".join(
            f"CASE WHEN {hit} THEN {c} ELSE Level_{k} END AS Level_{k}" for k, c in enumerate(cols, start=1)) + f" FROM {last})")
        last = f"s{i}"
    return f"SELECT * FROM (WITH {', '.join(steps)} SELECT * FROM {last}) t"


@query("tax_merge_topics_chained", oracle=with_views(_replay_sql(CHAIN), "taxonomy"))
def q_tax_merge_topics_chained(spark, sf):
    m = _lit(spark, CHAIN, "topic string, target string, seq int")
    return ED.tax_merge_topics(tables(spark, sf).taxonomy, m)


@query("tax_split_topics", oracle=with_views("""
SELECT t.entity, t.Level_1, coalesce(s.a, t.Level_2) AS Level_2, coalesce(s.a || '_0', t.Level_3) AS Level_3,
  coalesce(s.a || '_0', t.Level_4) AS Level_4, coalesce(s.a || '_0', t.Level_5) AS Level_5
FROM taxonomy t LEFT JOIN (
  SELECT sp.entity, g.a FROM sp JOIN (
    SELECT topic, seq, split_part(topic, '_', 1) || '_' || CAST(coalesce(x.mx, -1)
      + row_number() OVER (PARTITION BY split_part(topic, '_', 1) ORDER BY seq) AS STRING) AS a
    FROM (SELECT DISTINCT topic, seq FROM sp) q
    LEFT JOIN (SELECT Level_1 AS p, max(CAST(split_part(Level_2, '_', -1) AS INT)) AS mx FROM taxonomy GROUP BY Level_1) x
      ON x.p = split_part(q.topic, '_', 1)) g ON g.topic = sp.topic AND g.seq = sp.seq) s ON t.entity = s.entity""",
    "taxonomy", extra={"sp": f"SELECT * FROM (VALUES {_vals(SPLITS)}) v(topic, seq, entity)"}))
def q_tax_split_topics(spark, sf):
    s = _lit(spark, SPLITS, "topic string, seq int, entity string")
    return ED.tax_split_topics(tables(spark, sf).taxonomy, s)


# -- names and appended rows of the edits ----------------------------------------------
SPLIT_NAMES = [("3_1", 0, "First part"), ("3_1", 1, "Second part")]
BRANCH_SQL = f"""SELECT entity, country, '25' AS Level_1, Level_2, Level_2 || '_' || CAST(i AS STRING) AS Level_3
FROM (SELECT t.*, dense_rank() OVER (PARTITION BY Level_2 ORDER BY country) - 1 AS i,
             row_number() OVER (PARTITION BY entity ORDER BY country) AS rn
      FROM (SELECT *, {_L2} AS Level_2 FROM ctags) t) x WHERE rn = 1"""
_CT = {"tags": TAGS_SQL, "cont": CONT_SQL, "ctags": CTAGS_SQL, "branch": BRANCH_SQL}


@query("tax_append_country_branch", oracle=with_views("""
SELECT * FROM taxonomy WHERE entity NOT IN (SELECT entity FROM branch) UNION ALL
SELECT entity, Level_1, Level_2, Level_3, Level_3 AS Level_4, Level_3 AS Level_5 FROM branch""",
                                                      "doc_entities", "works", "taxonomy", extra=_CT))
def q_tax_append_country_branch(spark, sf):
    return ED.tax_append(tables(spark, sf).taxonomy, ED.tax_add_country_branch(_country_tags(spark, sf)))


@query("country_branch_names", oracle=with_views(
    "SELECT * FROM (VALUES " + ", ".join(f"(2, '25_{i}', '{c}')" for i, c in enumerate(ED.CONTINENTS)) + """) v(level, topic, name)
UNION ALL SELECT DISTINCT 3, Level_3, country FROM branch""", "doc_entities", "works", extra=_CT))
def q_country_branch_names(spark, sf):
    return ED.country_branch_names(_country_tags(spark, sf))


@query("tax_split_names", oracle=with_views(f"""
SELECT 2 AS level, '3_' || CAST(x.mx + 1 + n.seq AS STRING) AS topic, n.name
FROM (VALUES {_vals(SPLIT_NAMES)}) n(topic, seq, name)
CROSS JOIN (SELECT max(CAST(split_part(Level_2, '_', -1) AS INT)) AS mx FROM taxonomy WHERE Level_1 = '3') x""", "taxonomy"))
def q_tax_split_names(spark, sf):
    s = _lit(spark, SPLITS, "topic string, seq int, entity string")
    return ED.tax_split_names(tables(spark, sf).taxonomy, s, _lit(spark, SPLIT_NAMES, "topic string, seq int, name string"))


@query("tax_finalise_names", oracle=with_views("""
SELECT n.level, n.topic, n.name FROM topic_names n WHERE EXISTS (
  SELECT 1 FROM taxonomy t WHERE t.Level_1 <> '3' AND n.topic = CASE n.level WHEN 1 THEN t.Level_1 WHEN 2 THEN t.Level_2 ELSE t.Level_3 END)""",
                                               "taxonomy", "topic_names"))
def q_tax_finalise_names(spark, sf):
    t = tables(spark, sf)
    base = t.taxonomy.withColumn("seq", F.lit(0))
    moved = ED.tax_move_areas(t.taxonomy.where(F.col("Level_1") == "3"), MOVE_DOMAINS).withColumn("seq", F.lit(1))
    return ED.tax_finalise(base.unionByName(moved), t.topic_names)[1]
