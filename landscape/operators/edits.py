"""Table-driven taxonomy edits (survey 2.J).

Every edit list is a small literal table (a few dozen rows written by a
curator), joined with an explicit broadcast: its size is bounded by the
edit list, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVEL_COLS = [f"Level_{i}" for i in range(1, 6)]


def preprune_entities(entities: DataFrame, flagged: DataFrame, keep: DataFrame) -> DataFrame:
    """discarded = flagged - keep-list; result = all entities - discarded."""
    discarded = flagged.join(F.broadcast(keep), "entity", "left_anti")
    return entities.join(discarded, "entity", "left_anti")  # the flagged set grows with the mentions: no hint


def tax_discard(taxonomy: DataFrame, discard: DataFrame, pattern: str = r"\(film\)",
                flagged: DataFrame | None = None, preprocessed: DataFrame | None = None) -> DataFrame:
    """Without the listed entities, those ``flagged`` automatically (but for
    names with "International"), those matching ``pattern`` and, where given,
    those not among the ``preprocessed`` ones."""
    out = taxonomy.join(F.broadcast(discard.select("entity")), "entity", "left_anti").where(~F.col("entity").rlike(pattern))
    if flagged is not None:  # grows with the data: no hint
        out = out.join(flagged.select("entity").where(~F.col("entity").contains("International")), "entity", "left_anti")
    if preprocessed is not None:
        out = out.join(preprocessed.select("entity"), "entity", "left_semi")
    return out


def tax_rename(names: DataFrame, renames: DataFrame) -> DataFrame:
    """(level, topic, name) with overrides from (topic, new_name)."""
    return (names.join(F.broadcast(renames), "topic", "left")
            .select("level", "topic", F.coalesce("new_name", "name").alias("name")))


def tax_move_entities(taxonomy: DataFrame, moves: DataFrame) -> DataFrame:
    """Set Level_1..Level_3 of listed entities; Level_4 = Level_5 = Level_3."""
    m = moves.select("entity", *[F.col(f"Level_{i}").alias(f"_m{i}") for i in (1, 2, 3)])
    j = taxonomy.join(F.broadcast(m), "entity", "left")
    moved = F.col("_m1").isNotNull()
    cols = [F.when(moved, F.col(f"_m{i}")).otherwise(F.col(f"Level_{i}")).alias(f"Level_{i}") for i in (1, 2, 3)]
    cols += [F.when(moved, F.col("_m3")).otherwise(F.col(f"Level_{i}")).alias(f"Level_{i}") for i in (4, 5)]
    return j.select("entity", *cols)


def tax_drop_topics(taxonomy: DataFrame, drops: DataFrame) -> DataFrame:
    """Remove entities under listed (level, topic) branches."""
    out = taxonomy
    for lvl in (1, 2):
        d = drops.where(F.col("level") == lvl).select(F.col("topic").alias(f"Level_{lvl}"))
        out = out.join(F.broadcast(d), f"Level_{lvl}", "left_anti")
    return out.select("entity", *LEVEL_COLS)


def tax_move_areas(taxonomy: DataFrame, domains: list[str], new_root: str = "26") -> DataFrame:
    """Shift listed domains one level down under ``new_root``; old Level_5 dropped."""
    hit = F.col("Level_1").isin(domains)
    shifted = [F.lit(new_root)] + [F.concat(F.lit(new_root + "_"), F.col(f"Level_{i}")) for i in (1, 2, 3, 4)]
    return taxonomy.select("entity", *[F.when(hit, shifted[i - 1]).otherwise(F.col(f"Level_{i}")).alias(f"Level_{i}")
                                       for i in range(1, 6)])


def tax_finalise(edited: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the last edit per entity (highest ``seq``) and only the names of
    topics that still exist at their level."""
    w = Window.partitionBy("entity").orderBy(F.col("seq").desc())
    tax = edited.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "seq")
    alive = tax.select(F.inline(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic"))
                                         for i in range(1, 6)]))).distinct()
    return tax, names.join(alive, ["level", "topic"], "left_semi")


# Continent tags of the country branch and their Level_2 ids
# (any other continent goes to 25_7).
CONTINENTS = [
    "Africa",
    "Asia and Middle East",
    "Europe",
    "North America, Central America, and Caribbean",
    "South America",
    "Oceania",
    "Antarctica",
]
COUNTRY_ROOT = "25"


def country_tags(tags: DataFrame, entity_reassign: DataFrame, country_remove: DataFrame,
                 country_reassign: DataFrame, continents: DataFrame) -> DataFrame:
    """(country, entity, continent) from long (country, entity) tags: entities
    remapped, removed countries dropped, countries relabelled, continent mapped."""
    t = (tags.join(F.broadcast(entity_reassign), "entity", "left")
         .select("country", F.coalesce("new_entity", "entity").alias("entity"))
         .join(F.broadcast(country_remove), "country", "left_anti")
         .join(F.broadcast(country_reassign), "country", "left")
         .select(F.coalesce("new_country", "country").alias("country"), "entity"))
    return t.join(F.broadcast(continents), "country", "left").distinct()


def tax_append(taxonomy: DataFrame, branch: DataFrame) -> DataFrame:
    """The taxonomy with a branch added; an entity of both keeps its branch row."""
    cols = ["entity", *LEVEL_COLS]
    return taxonomy.join(branch.select("entity"), "entity", "left_anti").select(*cols).unionByName(branch.select(*cols))


def country_branch_names(tags: DataFrame) -> DataFrame:
    """(level, topic, name): continents at level 2, countries at level 3."""
    branch = tags.join(tax_add_country_branch(tags).select("entity", "Level_2", "Level_3"), "entity")
    first = branch.groupBy("Level_2", "Level_3").agg(F.min("country").alias("name"))
    l3 = first.select(F.lit(3).alias("level"), F.col("Level_3").alias("topic"), "name")
    fixed = tags.sparkSession.createDataFrame(
        [(2, f"{COUNTRY_ROOT}_{i}", c) for i, c in enumerate(CONTINENTS)], "level int, topic string, name string")
    return fixed.unionByName(l3)


def tax_add_country_branch(tags: DataFrame) -> DataFrame:
    """Country branch rows: Level_1 = 25, Level_2 by continent (25_0..25_6,
    else 25_7), Level_3 = the country's index inside its continent (by name),
    Level_4 = Level_5 = Level_3; an entity tagged with several countries keeps
    the first by name."""
    l2 = F.lit(f"{COUNTRY_ROOT}_7")
    for i, c in reversed(list(enumerate(CONTINENTS))):
        l2 = F.when(F.col("continent") == c, F.lit(f"{COUNTRY_ROOT}_{i}")).otherwise(l2)
    t = tags.withColumn("Level_2", l2)
    # countries are few (one row per country): rank them inside their continent
    idx = (t.select("Level_2", "country").distinct()
           .withColumn("_i", F.dense_rank().over(Window.partitionBy("Level_2").orderBy("country")) - 1))
    t = t.join(idx, ["Level_2", "country"])
    first = Window.partitionBy("entity").orderBy("country")
    t = t.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
    l3 = F.concat(F.col("Level_2"), F.lit("_"), F.col("_i").cast("string"))
    return t.select("entity", F.lit(COUNTRY_ROOT).alias("Level_1"), "Level_2", l3.alias("Level_3"),
                    l3.alias("Level_4"), l3.alias("Level_5"))


def _last_segment_max(taxonomy: DataFrame, parent_col: str, child_col: str) -> DataFrame:
    return (taxonomy.select(F.col(parent_col).alias("parent"), F.col(child_col).alias("_c")).distinct()
            .groupBy("parent").agg(F.max(F.element_at(F.split("_c", "_"), -1).cast("int")).alias("_max")))


def tax_merge_topics(taxonomy: DataFrame, merges: DataFrame) -> DataFrame:
    """Move a domain under another domain (new area = max area + 1, topics
    ``<area>_0``) or an area under another area (new topic = max topic + 1), one
    after the other in list order (``seq``): a merge finds what the merges before
    it made, moved or left.

    The list is a parameter and replayed on the driver, against the children of
    its targets only. Rows that the same merges catch move together, so the
    replay keeps where the rows of a domain, or of an area, have gone, and each
    row takes its place by one look-up: its area's, or else its domain's.
    """
    edits = [(r.topic, r.target) for r in merges.orderBy("seq").select("topic", "target").collect()]
    targets = [t for _, t in edits]
    kids = {}  # children of the targets, as the taxonomy has them
    for up, down in (("Level_1", "Level_2"), ("Level_2", "Level_3")):
        rows = taxonomy.where(F.col(up).isin(targets)).select(F.col(up).alias("p"), F.col(down).alias("c")).distinct().collect()
        for r in rows:
            kids.setdefault(r.p, set()).add(r.c)
    moved: dict[str, tuple[str, str, str]] = {}  # original domain or area -> where its rows are: domain, area, topic

    def children(parent: str) -> set[str]:
        """Those that rows sit in now: of the original ones, without those gone."""
        level = parent.count("_")
        now = {place[level + 1] for place in moved.values() if place[level] == parent}
        if parent in moved or parent.split("_")[0] in moved:  # its own rows are gone
            return now
        return now | {c for c in kids.get(parent, ()) if c not in moved}

    for topic, target in edits:
        at = max((int(c.split("_")[-1]) for c in children(target) if c), default=-1) + 1
        new = f"{target}_{at}"
        place = (target, new, f"{new}_0") if "_" not in target else (target.split("_")[0], target, new)
        level = topic.count("_")
        caught = {source for source, now in moved.items() if now[level] == topic}
        if topic not in moved and (level == 0 or topic.split("_")[0] not in moved):
            caught.add(topic)  # rows where they were from the start
        moved |= {source: place for source in caught}

    j = taxonomy
    for level, name in ((1, "_d"), (2, "_a")):
        rows = [(k, *v) for k, v in moved.items() if k.count("_") == level - 1]
        table = taxonomy.sparkSession.createDataFrame(rows, f"_k{level} string, {name}1 string, {name}2 string, {name}3 string")
        j = j.join(F.broadcast(table), F.col(f"Level_{level}") == F.col(f"_k{level}"), "left")  # as long as the list
    return j.select("entity", *[F.coalesce(f"_a{min(i, 3)}", f"_d{min(i, 3)}", f"Level_{i}").alias(f"Level_{i}") for i in range(1, 6)])


def _split_ids(taxonomy: DataFrame, splits: DataFrame) -> DataFrame:
    """(topic, seq, _a): the new area of every group."""
    groups = splits.select("topic", "seq").distinct().withColumn("domain", F.substring_index("topic", "_", 1))
    dmax = _last_segment_max(taxonomy, "Level_1", "Level_2").withColumnRenamed("parent", "domain")
    w = Window.partitionBy("domain").orderBy("seq")
    return (F.broadcast(groups).join(dmax, "domain", "left")
            .withColumn("_a", F.concat("domain", F.lit("_"), (F.coalesce("_max", F.lit(-1)) + F.row_number().over(w)).cast("string"))))


def tax_split_names(taxonomy: DataFrame, splits: DataFrame, names: DataFrame) -> DataFrame:
    """(level, topic, name) of the areas that a split makes; ``names``: (topic, seq, name)."""
    return (_split_ids(taxonomy, splits).join(F.broadcast(names), ["topic", "seq"])
            .select(F.lit(2).alias("level"), F.col("_a").alias("topic"), "name"))


def tax_split_topics(taxonomy: DataFrame, splits: DataFrame) -> DataFrame:
    """Give listed entity groups new areas inside the domain of ``topic``:
    consecutive ids after the domain's largest area (``seq`` orders groups),
    topics ``<area>_0``. ``splits``: (topic, seq, entity)."""
    ids = _split_ids(taxonomy, splits)
    ent = F.broadcast(splits.join(ids.select("topic", "seq", "_a"), ["topic", "seq"]).select("entity", "_a"))
    j = taxonomy.join(ent, "entity", "left")
    s = F.col("_a").isNotNull()
    return j.select("entity", "Level_1", F.when(s, F.col("_a")).otherwise(F.col("Level_2")).alias("Level_2"),
                    *[F.when(s, F.concat("_a", F.lit("_0"))).otherwise(F.col(f"Level_{i}")).alias(f"Level_{i}")
                      for i in (3, 4, 5)])
