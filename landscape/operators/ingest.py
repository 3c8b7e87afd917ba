"""Sources, sinks and document normalisation (survey 2.A / 2.B).

Nested records are flattened with ``explode`` / higher-order functions
against explicit schemas; texts are inverted in an Arrow pass. Abstracts travel as inverted indexes
``{word: [positions]}`` and are rebuilt with map and array functions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import global_row_number
from ..session import scratch_path
from ..sources.json_arrays import read_json_arrays

# Schema of the raw work records this engine reads (a subset of the source
# format: unread fields are simply not declared, so the reader skips them).
INSTITUTION = T.StructType([T.StructField(n, T.StringType()) for n in
                            ("id", "display_name", "ror", "country_code", "type", "homepage_url")])
WORK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("publication_year", T.IntegerType()),
    T.StructField("publication_date", T.StringType()),
    T.StructField("host_venue", T.StructType([T.StructField(n, T.StringType()) for n in
                                              ("id", "display_name", "url", "publisher")])),
    T.StructField("authorships", T.ArrayType(T.StructType([
        T.StructField("author_position", T.StringType()),
        T.StructField("author", T.StructType([T.StructField(n, T.StringType()) for n in
                                              ("id", "display_name", "orcid")])),
        T.StructField("institutions", T.ArrayType(INSTITUTION)),
        T.StructField("raw_affiliation_string", T.StringType())]))),
    T.StructField("concepts", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in
                                                        ("id", "wikidata", "display_name", "level", "score")]))),
    T.StructField("mesh", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in
                                                    ("descriptor_ui", "descriptor_name", "qualifier_name")]))),
    T.StructField("referenced_works", T.ArrayType(T.StringType())),
    T.StructField("abstract_inverted_index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    T.StructField("cited_by_count", T.IntegerType()),
    T.StructField("is_retracted", T.BooleanType()),
    T.StructField("is_paratext", T.BooleanType()),
])


def read_works_json(spark, path: str, multi_line: bool = True) -> DataFrame:
    """Yearly JSON files of work records, read with the declared schema (no
    inference pass over the data). By default a file is one array of records,
    however it is indented, read by as many tasks as it has splits; with
    ``multi_line`` off every line is a record or an array, for Spark's own reader.
    A corrupt record fails the read."""
    if multi_line:
        return read_json_arrays(spark, path, WORK_SCHEMA)
    return spark.read.schema(WORK_SCHEMA).option("mode", "FAILFAST").json(path)


INVERTED_BYTES = 1 << 20  # of texts whose indexes leave a task at once


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words, positions) of (id, text as bytes): the distinct words of each text and where they are."""
    for batch in batches:
        ids, texts = batch.columns
        rows, held, size = [], [], 0
        for i in range(batch.num_rows + 1):
            if rows and (i == batch.num_rows or size >= INVERTED_BYTES):
                words = [w for at in held for w in at]
                positions = [p for at in held for p in at.values()]
                ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                inner = np.cumsum([0, *map(len, positions)]).astype(np.int32)
                where = pa.ListArray.from_arrays(pa.array(inner), pa.array([x for p in positions for x in p], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(words, pa.binary())),
                                                  pa.ListArray.from_arrays(pa.array(ends), where)], names=["id", "words", "positions"])
                rows, held, size = [], [], 0
            if i < batch.num_rows and texts[i].is_valid:
                text, at = texts[i].as_py(), {}
                for pos, word in enumerate(text.split(b" ")):
                    at.setdefault(word, []).append(pos)
                rows.append(i)
                held.append(at)
                size += len(text)


def invert_abstract(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, {word: [positions]}) from text split on single spaces. A text is inverted
    where it is read, inside its row; only the indexes of ids that come more than once
    (or of no id) are moved, to be merged into one."""
    kind = df.schema[id_col].dataType.simpleString()
    inv = (df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
           .mapInArrow(_inverted, f"id {kind}, words array<binary>, positions array<array<int>>")
           .select(F.col("id").alias(id_col), F.col("words").cast("array<string>").alias("words"), "positions"))
    ids = df.where(F.col(text).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"))
    path = scratch_path(df.sparkSession, "repeated-ids")
    ids.where("_n > 1").select("_id").write.parquet(path)  # few where ids are keys, and never more than half of the rows
    repeated = df.sparkSession.read.parquet(path)

    def index(words: Column, positions: Column) -> Column:
        return F.map_from_arrays(words, positions).alias("abstract_inverted_index")

    if repeated.isEmpty():
        return inv.select(id_col, index(F.col("words"), F.col("positions")))
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    words = (inv.join(repeated, same, "left_semi").select(id_col, F.inline(F.arrays_zip("words", "positions"))))
    merged = (words.groupBy(id_col, "words").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
              .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("words", "positions"))).alias("abstract_inverted_index")))
    return (inv.join(repeated, same, "left_anti").select(id_col, index(F.col("words"), F.col("positions")))
            .unionByName(merged))


def deinvert_abstract(df: DataFrame, id_col: str = "id", inv: str = "abstract_inverted_index") -> DataFrame:
    """Rebuild the text: words in position order, a missing position counting
    as an empty string, joined by single spaces; empty or missing index -> NULL.

    (position, word) pairs are sorted once (n log n); a word is preceded by as
    many spaces as the distance to the previous position, which reproduces the
    empty strings of any gaps. No map lookups (a map lookup is a linear scan).
    """
    pos_word = F.array_sort(F.flatten(F.transform(
        F.map_entries(inv), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("k"), e["key"].alias("v"))))))
    # project the sorted array first: a lambda referring to an expression would
    # re-evaluate it for every element
    pw = F.col("_pw")
    pieces = F.transform(pw, lambda x, i: F.concat(
        F.repeat(F.lit(" "), x["k"] - F.when(i == 0, F.lit(0)).otherwise(pw[i - 1]["k"])), x["v"]))
    return (df.select(id_col, F.size(inv).alias("_n"), pos_word.alias("_pw"))
            .select(id_col, F.when(F.col("_n") > 0, F.array_join(pieces, "")).alias("abstract")))


def work_metadata(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("work_id"), "doi", "display_name", "publication_year",
                      "publication_date", "cited_by_count", "is_retracted",
                      F.col("host_venue.id").alias("venue_id"),
                      F.col("host_venue.display_name").alias("venue_display_name"),
                      F.col("host_venue.url").alias("venue_url"))


def work_mesh(raw: DataFrame) -> DataFrame:
    """One row per (work, subject heading)."""
    return (raw.select(F.col("id").alias("doc_id"), F.explode("mesh").alias("m"))
            .select("doc_id", "m.descriptor_ui", "m.descriptor_name", "m.qualifier_name"))


def work_concepts(raw: DataFrame, variable: str = "concepts") -> DataFrame:
    return (raw.select(F.col("id").alias("doc_id"), F.explode(variable).alias("c"))
            .select("doc_id", "c.id", "c.display_name", F.col("c.score").cast("double").alias("score")))


def work_authorships(raw: DataFrame) -> DataFrame:
    """One row per (work, author, institution); authors without institutions vanish."""
    a = raw.select("id", F.explode("authorships").alias("a"))
    return (a.select("id", F.col("a.author.id").alias("auth_id"),
                     F.col("a.author.display_name").alias("auth_display_name"),
                     F.col("a.author.orcid").alias("auth_orcid"),
                     F.col("a.raw_affiliation_string").alias("affiliation_string"),
                     F.explode("a.institutions").alias("i"))
            .select("id", "auth_id", "auth_display_name", "auth_orcid", "affiliation_string",
                    F.col("i.id").alias("inst_id")))


def institution_metadata(raw: DataFrame) -> DataFrame:
    i = raw.select(F.explode("authorships").alias("a")).select(F.explode("a.institutions").alias("i"))
    fields = [f for f in ("id", "display_name", "country_code", "type", "homepage_url")
              if f in i.schema["i"].dataType.names]
    return i.select(*[f"i.{f}" for f in fields]).dropDuplicates(["id"])


def work_citations(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("id").alias("citing"), F.explode("referenced_works").alias("cited"))


def reformat_entities(annotations: DataFrame, threshold: int = 70) -> DataFrame:
    """(doc_id, entities): entity = last URI segment with '_' as space, kept
    when confidence >= threshold; documents with none keep an empty list."""
    kept = F.filter("annotations", lambda a: a["confidence"] >= threshold)
    names = F.transform(kept, lambda a: F.regexp_replace(F.element_at(F.split(a["URI"], "/"), -1), "_", " "))
    return annotations.select("doc_id", names.alias("entities"))


def patent_dates(raw: DataFrame, cols=("publication_date", "filing_date", "grant_date", "priority_date")) -> DataFrame:
    """yyyymmdd integers -> dates; 0 and impossible dates -> NULL."""
    return raw.select("publication_number", *_dates(cols))


def _dates(cols) -> list[Column]:
    return [F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyyMMdd")).cast("date").alias(c) for c in cols]


def english_text(raw: DataFrame) -> DataFrame:
    return raw.select("publication_number", *_texts())


def _texts() -> list[Column]:
    def en(c):
        return F.get(F.filter(c, lambda x: x["language"] == "en"), 0)["text"]
    return [en(F.col("title_localized")).alias("title"), en(F.col("abstract_localized")).alias("abstract")]


def unnest_parties(raw: DataFrame) -> DataFrame:
    return raw.select("publication_number", *_parties())


def _parties() -> list[Column]:  # a field of an array of structs is the array of the field
    return [F.col(f"{p}_harmonized")[field].alias(f"{p}_harmonized_{out}")
            for p in ("inventor", "assignee") for field, out in (("name", "names"), ("country_code", "country_codes"))]


def cpc_codes(raw: DataFrame) -> DataFrame:
    return raw.select("publication_number", _cpc())


def _cpc() -> Column:
    return F.transform("cpc", lambda x: x["code"]).alias("cpc_codes")


def patent_records(raw: DataFrame) -> DataFrame:
    """All columns of the normalised patents, read from the raw records once."""
    dates = ("publication_date", "filing_date", "grant_date", "priority_date")
    return raw.select("publication_number", "family_id", *_dates(dates), *_texts(), *_parties(), _cpc())


def assignee_types(parties: DataFrame) -> DataFrame:
    """PERSON when the assignee is also an inventor, else ORGANISATION,
    position by position."""
    return parties.select("publication_number", "assignee_harmonized_names", F.transform(
        "assignee_harmonized_names",
        lambda a: F.when(F.array_contains("inventor_harmonized_names", a), "PERSON").otherwise("ORGANISATION"))
        .alias("assignee_types"))


def patent_org_rows(parties_typed: DataFrame) -> DataFrame:
    """Patents whose name and type arrays align, exploded in lockstep, organisations only."""
    d = parties_typed.where(F.size("assignee_harmonized_names") == F.size("assignee_types"))
    z = d.select("publication_number", F.inline(F.arrays_zip(
        F.col("assignee_harmonized_names").alias("org"), F.col("assignee_types").alias("org_type"))))
    return z.where(F.col("org_type") == "ORGANISATION")


def annotation_lookup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, abstract without line ends) of works or patents, as sent to annotation."""
    return df.select(F.col(id_col).alias("id"), F.regexp_replace(text_col, "\n", "").alias("abstract"))


def topics_long(doc_topic_lists: DataFrame) -> DataFrame:
    """{doc: [topic, ...]} rows -> (id, topic); documents without topics drop out."""
    return doc_topic_lists.select(F.col("doc_id").alias("id"), F.explode("topics").alias("topic"))


def concat_yearly_parts(parts: DataFrame, key: str, ties: Sequence[str] = ()) -> DataFrame:
    """One table from per-year parts; a key present in several years keeps
    the row of the latest year (ties: the largest ``ties`` columns)."""
    w = Window.partitionBy(key).orderBy(F.col("year").desc(), *[F.col(c).desc() for c in ties])
    return parts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def write_by_year(df: DataFrame, path: str) -> None:
    """One folder per year. The rebalance keeps a year's rows together where they
    are few and lets AQE split a hot year over several tasks and files."""
    df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def patent_family_extract(records: DataFrame, start: str = "2007-01-01", end: str = "2022-12-31") -> DataFrame:
    """``patent_records`` with a GB inventor and an English abstract filed in [start,
    end], one publication per family (the smallest number), all columns."""
    ok = (records
          .where(F.array_contains("inventor_harmonized_country_codes", "GB") & F.col("abstract").isNotNull()
                 & F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    first = ok.groupBy("family_id").agg(F.min("publication_number").alias("publication_number"))
    return ok.join(first, ["family_id", "publication_number"])


def citation_request_batches(works: DataFrame, citations: DataFrame, min_citations: int = 0,
                             year: int | None = None, with_references: bool = False,
                             per_request: int = 50, per_chunk: int = 350) -> DataFrame:
    """Ids to query, URL prefix stripped, packed ``per_request`` to a request
    (``id|id|...``) and requests grouped ``per_chunk`` to a chunk, in id order."""
    focus = works.where(F.col("cited_by_count") >= min_citations)
    if year is not None:
        focus = focus.where(F.col("publication_year") == year)
    ids = focus.select(F.col("work_id").alias("id"))
    if with_references:
        refs = citations.join(ids.withColumnRenamed("id", "citing"), "citing", "left_semi").select(F.col("cited").alias("id"))
        ids = ids.unionByName(refs)
    ids = ids.select(F.regexp_replace("id", r"^https?://[^/]+/", "").alias("id")).distinct()
    numbered = global_row_number(ids, ["id"])
    batch = F.floor((F.col("rn") - 1) / per_request)
    b = (numbered.withColumn("batch", batch.cast("bigint"))
         .groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"),
                               F.count("*").alias("n_ids")))
    return b.withColumn("chunk", F.floor(F.col("batch") / per_chunk).cast("bigint"))


# Response pages of the citation API: {meta: {...}, results: [{id, referenced_works}]}
PAGE_SCHEMA = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("count", T.LongType()), T.StructField("page", T.IntegerType())])),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("referenced_works", T.ArrayType(T.StringType()))]))),
])


def parse_forward_citations(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """(citing, cited) edges from response pages; a work listed on several
    pages keeps the entry of the last page."""
    p = pages.select(F.from_json(json_col, PAGE_SCHEMA).alias("p"))
    r = p.select(F.col("p.meta.page").alias("page"), F.explode("p.results").alias("r"))
    w = Window.partitionBy("id").orderBy(F.col("page").desc())
    last = (r.select("page", F.col("r.id").alias("id"), F.col("r.referenced_works").alias("refs"))
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1))
    return last.select(F.col("id").alias("citing"), F.explode("refs").alias("cited"))


def patent_count_probe(patents: DataFrame, parties: DataFrame, texts: DataFrame, country: str = "GB",
                       filed: tuple[str, str] | None = None) -> DataFrame:
    """Distinct publications and families for inventor / assignee / either
    country filters, with and without an English abstract (6 counts), of
    patents filed in an inclusive date range where one is given."""
    if filed:
        patents = patents.where(F.col("filing_date").between(*[F.lit(x).cast("date") for x in filed]))
    d = patents.join(parties, "publication_number").join(texts, "publication_number")
    inv = F.array_contains("inventor_harmonized_country_codes", country)
    asg = F.array_contains("assignee_harmonized_country_codes", country)
    en = F.col("abstract").isNotNull()
    variants = [(name, english, cond & en if english else cond)
                for name, cond in (("inventor", inv), ("assignee", asg), ("inventor_or_assignee", inv | asg))
                for english in (False, True)]
    # one pass: flags per publication, flags per family, then six sums of each
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(f"f{i}") for i, (_, _, c) in enumerate(variants)]
    sums = [F.coalesce(F.sum(F.col(f"f{i}").cast("long")), F.lit(0)).alias(f"n{i}") for i in range(len(variants))]
    counts = [d.groupBy(key).agg(*flags).where(F.col(key).isNotNull()).agg(*sums)
              for key in ("publication_number", "family_id")]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(v).alias("variant"), F.lit(e).alias("english_only"), F.col(f"n{i}").alias(name))
            for i, (v, e, _) in enumerate(variants)])))

    return long(counts[0], "n_publications").join(long(counts[1], "n_families"), ["variant", "english_only"])
