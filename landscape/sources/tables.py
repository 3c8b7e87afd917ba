"""Domain tables over the driver's parquet files.

The driver ships TPC-H-shaped tables; ``FIXTURES.md`` maps them onto the
research-landscape domain (works, patents, entity mentions, a five-level
taxonomy, ...). Every view here is a lazy DataFrame over the parquet scans,
so filters and projections of the operators reach the scan.

Joins between two tables that grow with the data (lineitem x orders) are
left to the planner: sort-merge by default, broadcast only when Spark's own
size check (static estimate, then AQE's runtime statistics) allows it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _s(c: Column) -> Column:
    return c.cast("string")


def _floor_div(c: Column, d: int) -> Column:
    return F.floor(c / F.lit(d)).cast("bigint")


class Tables:
    """Base tables and derived domain views for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stages: dict[str, DataFrame] = {}

    def stage(self, name: str, build, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``build()`` once as parquet under the shared checkpoint folder
        and read it back: later queries start from a short plan, and a lost
        executor re-reads files instead of recomputing the lineage."""
        if name not in self._stages:
            path = scratch_path(self.spark, f"stage-{name}")
            writer = build().write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(path)
            self._stages[name] = self.spark.read.parquet(path)
        return self._stages[name]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            df = self.base(name)
            self.__dict__[name] = df
            return df
        raise AttributeError(name)

    # -- taxonomy -----------------------------------------------------------
    @cached_property
    def taxonomy(self) -> DataFrame:
        """entity, Level_1..Level_5 path ids; short branches carry down."""
        p = F.col("p_partkey")
        l1 = _s(p % 4)
        l2 = F.concat(l1, F.lit("_"), _s(_floor_div(p, 4) % 3))
        l3 = F.concat(l2, F.lit("_"), _s(_floor_div(p, 12) % 3))
        l4 = F.when(p % 5 == 0, l3).otherwise(
            F.concat(l3, F.lit("_"), _s(_floor_div(p, 36) % 2)))
        l5 = F.when((p % 5 == 0) | (p % 7 == 0), l4).otherwise(
            F.concat(l4, F.lit("_"), _s(_floor_div(p, 72) % 2)))
        return (self.part.where(p % 11 != 10)
                .select(F.concat(F.lit("e"), _s(p)).alias("entity"),
                        l1.alias("Level_1"), l2.alias("Level_2"), l3.alias("Level_3"),
                        l4.alias("Level_4"), l5.alias("Level_5")))

    # -- documents ----------------------------------------------------------
    @cached_property
    def works(self) -> DataFrame:
        o, c, n = self.orders, self.customer, self.nation
        k = F.col("o_orderkey")
        return (o.where(F.col("o_orderstatus") != "F")
                .join(c, o.o_custkey == c.c_custkey)
                .join(n, c.c_nationkey == n.n_nationkey)
                .select(F.concat(F.lit("W"), _s(k)).alias("work_id"),
                        F.concat(F.lit("Order "), _s(k)).alias("display_name"),
                        F.when(k % 97 == 0, F.lit(None).cast("int"))
                        .otherwise(F.year("o_orderdate").cast("int")).alias("publication_year"),
                        F.col("o_orderdate").cast("date").alias("publication_date"),
                        F.when(k % 53 == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("n_name")).alias("venue_display_name"),
                        ((k * 13) % 120).cast("int").alias("cited_by_count")))

    @cached_property
    def patents(self) -> DataFrame:
        k = F.col("o_orderkey")
        return (self.orders.where(F.col("o_orderstatus") == "F")
                .select(F.concat(F.lit("P"), _s(k)).alias("publication_number"),
                        _s(_floor_div(k, 3)).alias("family_id"),
                        F.col("o_orderdate").cast("date").alias("publication_date")))

    def _line_docs(self, lines: DataFrame | None = None) -> DataFrame:
        li = self.lineitem if lines is None else lines
        o = self.orders.select("o_orderkey", "o_orderstatus")
        return li.join(o, li.l_orderkey == o.o_orderkey)

    @staticmethod
    def _doc_id() -> Column:
        return F.concat(F.when(F.col("o_orderstatus") == "F", "P").otherwise("W"),
                        _s(F.col("l_orderkey")))

    def line_entities(self, lines: DataFrame | None = None, *own: str | Column) -> DataFrame:
        """The mentions with the key of their order, and ``own`` columns of the ``lines`` or their orders."""
        return self._line_docs(lines).select(
            "l_orderkey", *own, self._doc_id().alias("doc_id"),
            F.when(F.col("o_orderstatus") == "F", "patents").otherwise("openalex").alias("source"),
            F.col("l_linenumber").cast("int").alias("pos"),
            F.concat(F.lit("e"), _s(F.col("l_partkey"))).alias("entity"),
            (F.lit(50) + F.lit(10) * (F.col("l_quantity").cast("int") % 6)).cast("int").alias("confidence"))

    @cached_property
    def doc_entities(self) -> DataFrame:
        """The central long table: one row per entity mention."""
        return self.line_entities().drop("l_orderkey")

    @cached_property
    def doc_orgs(self) -> DataFrame:
        s = self.supplier.select("s_suppkey", "s_name")
        d = self._line_docs()
        return (d.join(s, d.l_suppkey == s.s_suppkey)
                .select(self._doc_id().alias("doc_id"), F.col("s_name").alias("org"),
                        F.when(F.col("l_suppkey") % 5 == 0, "PERSON")
                        .otherwise("ORGANISATION").alias("org_type")))

    @cached_property
    def cd_scores(self) -> DataFrame:
        wid = F.substring("work_id", 2, 1 << 30).cast("bigint")
        return (self.works
                .where(F.col("publication_year").between(1994, 2000) & (wid % 3 != 0))
                .select("work_id",
                        (((wid * 7919) % 2001 - 1000) / F.lit(1000.0)).alias("cd_score"),
                        F.col("publication_year").alias("year")))

    def order_references(self) -> DataFrame:
        """(o_orderkey, cited): the works that an order cites, floor(k/2), floor(k/3) and floor(k/4); made distinct inside the row."""
        k = F.col("o_orderkey")
        cited = F.array_distinct(F.array(*[F.concat(F.lit("W"), _s(_floor_div(k, d))) for d in (2, 3, 4)]))
        return self.orders.where(k >= 10).select("o_orderkey").distinct().select("o_orderkey", cited.alias("cited"))

    @cached_property
    def citations(self) -> DataFrame:
        return self.order_references().select(F.concat(F.lit("W"), _s(F.col("o_orderkey"))).alias("citing"), F.explode("cited").alias("cited"))

    @cached_property
    def entity_embeddings(self) -> DataFrame:
        return self.embeddings.select(
            F.concat(F.lit("e"), _s(F.col("vec_id"))).alias("entity"), "embedding", "label")

    @cached_property
    def entity_groups(self) -> DataFrame:
        e = self.entity_embeddings
        t = self.taxonomy.select("entity")
        return (e.join(t, "entity")
                .where(F.substring("entity", 2, 1 << 30).cast("bigint") < 120)
                .select(F.when(F.col("label") % 2 == 0, "natural").otherwise("social").alias("area"),
                        F.concat(F.lit("d"), _s(F.col("label"))).alias("discipline"), "entity"))

    @cached_property
    def topic_names(self) -> DataFrame:
        t = self.taxonomy
        lv = t.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("level"), F.col(f"Level_{i}").alias("topic")) for i in (1, 2, 3)])))
        return (lv.where(F.col("topic") != "3_2_1").distinct()
                .select("level", "topic", F.concat(F.lit("Name "), F.col("topic")).alias("name")))

    # -- convenience --------------------------------------------------------
    @cached_property
    def docs(self) -> DataFrame:
        """(doc_id, source, year, title) for works and patents."""
        w = self.works.select(F.col("work_id").alias("doc_id"), F.lit("openalex").alias("source"),
                              F.col("publication_year").alias("year"),
                              F.col("display_name").alias("title"))
        p = self.patents.select(F.col("publication_number").alias("doc_id"), F.lit("patents").alias("source"),
                                F.year("publication_date").cast("int").alias("year"),
                                F.col("publication_number").alias("title"))
        return w.unionByName(p)
