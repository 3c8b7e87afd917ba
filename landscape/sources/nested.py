"""Nested source records built from the flat domain views.

The operators of 2.A/2.B read nested work and patent records. These
builders produce them from the driver's tables with ``collect_list`` of
structs per document (a document has a handful of lines), so every
flattening operator can be checked against the flat view it came from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import unit_hash
from .tables import Tables


def _yyyymmdd(c) -> F.Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def _suppliers(t: Tables) -> DataFrame:
    """(s_suppkey, _s): a row per key; staged, so that its size is known where it is joined to lines."""
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("s_suppkey").agg(F.collect_list(F.struct("s_name", "n_name")).alias("_s"))


def raw_works(t: Tables) -> DataFrame:
    """Nested work records. What a record is made of is grouped as short keys; the
    structs with their texts are built inside the grouped row."""
    k = F.col("l_orderkey")

    def inst(x):
        return F.struct(F.concat(F.lit("I"), x["l_suppkey"].cast("string")).alias("id"),
                        x["s_name"].alias("display_name"), F.lit(None).cast("string").alias("ror"),
                        x["n_name"].alias("country_code"), F.lit("education").alias("type"))

    def auth(x):
        return F.struct(F.lit("middle").alias("author_position"),
                        F.struct(F.concat(F.lit("A"), k.cast("string"), F.lit("_"), x["l_linenumber"].cast("string")).alias("id"),
                                 x["s_name"].alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"),
                        F.when((k + x["l_linenumber"]) % 7 == 0, F.array().cast("array<struct<id:string,display_name:string,ror:string,country_code:string,type:string>>"))
                        .otherwise(F.array(inst(x))).alias("institutions"),
                        x["s_name"].alias("raw_affiliation_string"))

    def concept(x):
        return F.struct(x["entity"].alias("id"), F.lit(None).cast("string").alias("wikidata"),
                        x["entity"].alias("display_name"), F.lit("0").alias("level"),
                        (x["confidence"] / F.lit(100.0)).cast("string").alias("score"))

    # lines are moved once, with the names of their supplier; orders come last, so that what is grouped by order stays where it was joined
    lines = t.lineitem.join(t.stage("suppliers", lambda: _suppliers(t)), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    names = F.when(F.col("o_orderstatus") != "F", F.col("_s")).alias("_s")
    lines = t.line_entities(lines, "l_linenumber", "l_suppkey", names).where(F.col("source") == "openalex")
    parts = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("l_linenumber", "l_suppkey", "_s"))).alias("_a"),
        F.collect_list(F.struct("entity", "confidence")).alias("_c"))
    named = F.flatten(F.transform("_a", lambda x: F.transform(x["_s"], lambda y: F.struct(
        x["l_linenumber"].alias("l_linenumber"), x["l_suppkey"].alias("l_suppkey"), y["s_name"].alias("s_name"), y["n_name"].alias("n_name")))))
    parts = parts.select("l_orderkey", F.when(F.size("_a") > 0, named).alias("_a"), "_c")
    refs = t.order_references().select(F.col("o_orderkey").alias("_k"), F.col("cited").alias("referenced_works"))
    w = t.works
    wk = F.substring("work_id", 2, 1 << 30).cast("bigint")
    base = w.select(F.col("work_id").alias("id"), F.concat(F.lit("10.1/"), F.col("work_id")).alias("doi"),
                    "display_name", "publication_year", F.col("publication_date").cast("string").alias("publication_date"),
                    F.struct(F.when(F.col("venue_display_name").isNotNull(),
                                    F.concat(F.lit("V"), F.col("venue_display_name"))).alias("id"),
                             F.col("venue_display_name").alias("display_name"),
                             F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("publisher"))
                    .alias("host_venue"),
                    "cited_by_count", (wk % 101 == 0).alias("is_retracted"), F.lit(False).alias("is_paratext"))
    own = [c for c in base.columns if c != "id"]
    base = base.withColumn("_w", F.substring("id", 2, 1 << 30).cast("bigint"))
    return (base.join(parts, F.col("_w") == F.col("l_orderkey"), "left").join(refs, F.col("_w") == F.col("_k"), "left")
            .select("id", *own, F.transform("_a", auth).alias("authorships"), F.transform("_c", concept).alias("concepts"), "referenced_works")
            .withColumn("abstract_inverted_index",
                        F.lit(None).cast("map<string,array<int>>")))


def raw_patents(t: Tables) -> DataFrame:
    o = t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    lines = (li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
             .join(n, s.s_nationkey == n.n_nationkey))
    # fixture country codes: every third nation stands in for GB
    cc = F.when(F.col("s_nationkey") % 3 == 0, "GB").otherwise(F.substring("n_name", 1, 2))
    party = F.struct(F.col("l_linenumber").alias("pos"), F.col("s_name").alias("name"), cc.alias("country_code"))
    person = F.col("l_suppkey") % 5 == 0
    parties = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.when(person, party))).alias("_inv"),
        F.array_sort(F.collect_list(party)).alias("_asg"))
    strip = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["country_code"].alias("country_code")))
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    text = lambda lang, s: F.struct(F.lit(lang).alias("language"), s.alias("text"))
    ks = k.cast("string")
    return (o.join(parties, o.o_orderkey == parties.l_orderkey, "left").select(
        F.concat(F.lit("P"), ks).alias("publication_number"),
        F.concat(F.lit("AP"), ks).alias("application_number"),
        F.lit("GB").alias("country_code"),
        F.floor(k / 3).cast("bigint").cast("string").alias("family_id"),
        F.array(text("en", F.concat(F.lit("Patent "), ks))).alias("title_localized"),
        F.when(k % 4 == 0, F.array(text("fr", F.concat(F.lit("Resume "), ks))))
        .otherwise(F.array(text("fr", F.concat(F.lit("Resume "), ks)),
                           text("en", F.concat(F.lit("Abstract "), ks, F.lit("\nsecond line")))))
        .alias("abstract_localized"),
        _yyyymmdd(d).alias("publication_date"),
        F.when(k % 10 == 0, F.lit(0)).otherwise(_yyyymmdd(F.date_sub(d, 200))).alias("filing_date"),
        F.when(k % 13 == 0, F.lit(20070230)).otherwise(_yyyymmdd(F.date_add(d, 100))).alias("grant_date"),
        F.lit(0).alias("priority_date"),
        F.array(F.struct(F.concat(F.lit("A0"), (k % 10).cast("string")).alias("code")),
                F.struct(F.concat(F.lit("B"), (k % 7).cast("string")).alias("code"))).alias("cpc"),
        strip(F.coalesce("_inv", F.array())).alias("inventor_harmonized"),
        strip(F.coalesce("_asg", F.array())).alias("assignee_harmonized")))


def annotations(t: Tables) -> DataFrame:
    """{doc: [{URI, confidence}]} rows from the mention table."""
    ann = F.struct(F.concat(F.lit("http://x/resource/"), F.col("entity"), F.lit("_"), F.col("source")).alias("URI"),
                   F.col("confidence"))
    return t.doc_entities.groupBy("doc_id").agg(F.collect_list(ann).alias("annotations"))


def write_simulation_runs(taxonomy: DataFrame, path: str, ratios: Sequence[int], runs: int = 1,
                          kind: str = "sample") -> None:
    """Write one table per (ratio, run): the taxonomy of a hash sample of
    ``ratio`` percent of its entities. One job writes all of them."""
    spark = taxonomy.sparkSession
    grid = spark.createDataFrame([(r, s) for r in ratios for s in range(runs)], "ratio int, simul int")
    name = F.concat(F.lit(f"community_{kind}_"), F.lpad(F.col("ratio").cast("string"), 2, "0"),
                    F.lit("_simul_"), F.col("simul").cast("string"))
    sampled = (taxonomy.crossJoin(F.broadcast(grid))  # literal parameter table
               .where(unit_hash(F.concat_ws("|", "entity", "simul"), 17) < F.col("ratio") / F.lit(100.0))
               .withColumn("run", name).drop("ratio", "simul"))
    sampled.write.mode("overwrite").partitionBy("run").parquet(path)


ARRAY_RECORDS = 5000


def write_json_arrays(records: DataFrame, path: str, by: str, compression: str = "none") -> None:
    """One folder per value of ``by``, of files that each hold one indented array of
    up to ``ARRAY_RECORDS`` records: what is held as a whole has that bound, however
    many records a value of ``by`` has. Records are sorted before they become texts, which
    are many times as long."""
    text = (records.sortWithinPartitions(by)
            .select(F.col(by).alias("part"), F.to_json(F.struct(*records.columns), {"pretty": "true"}).alias("value")))
    kind = text.schema["part"].dataType

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, of = None, [], None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], of), pa.array(["[\n" + ",\n".join(held) + "\n]"], pa.string())], names=["part", "value"])

        for batch in batches:
            of = batch.schema.field("part").type
            for part, value in zip(batch.column("part").to_pylist(), batch.column("value").to_pylist()):
                if held and (part != now or len(held) == ARRAY_RECORDS):
                    yield closed()
                    held = []
                now = part
                held.append(value)
        if held:
            yield closed()

    (text.mapInArrow(arrays, f"part {kind.simpleString()}, value string")
     .write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", compression).partitionBy("part").text(path))


LINE_RECORDS = 50_000


def write_json_lines(records: DataFrame, path: str) -> None:
    """Compressed files of up to ``LINE_RECORDS`` lines, each a record: such a file is read by one task."""
    records.write.mode("overwrite").option("maxRecordsPerFile", LINE_RECORDS).option("compression", "gzip").json(path)
