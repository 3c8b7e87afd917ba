"""Corpus pipeline: language identification, toxicity, near-duplicate removal
and packing, each stage written as Parquet and reread by the next.

Every stage works on whole texts of all its predecessor kept. A row without a
text, whose text has no letter, or that the network takes for noise rather than
one of its languages, is rejected by the first stage; null ids,
repeated rows and extra columns pass through as the stages' operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landscape.llm.common import read, stage
from landscape.llm.language_id import UNKNOWN, ConvParams, identify_languages, learn_languages
from landscape.llm.near_dedup import near_duplicates
from landscape.llm.packing import pack_documents
from landscape.llm.toxicity import learn_toxicity, score_toxicity

NAMING = ConvParams(noise=1.0, doubt=0.5)  # documents that are noise with more than this probability go
TOXIC = 0.5  # documents with this score or more go
SENT_IDS = 1_000_000  # ids that are sent to all tasks at most; more are joined by a shuffle


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network, learned from the stage's own
    input, can name; those without a text or a letter go, and those it takes for
    noise. A text in a language that is not learned is named after the one it looks
    like most, or taken for noise: which, is not defined. What is labelled as a
    language and drawn into the training sample is learned as such. Without any labelled document nothing can be learned, and
    the rule is the letter alone."""
    model = learn_languages(docs, params=NAMING)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = identify_languages(docs, model, lang_pred="__lang", score="__lang_score")
    return named.filter(F.col("__lang") != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the learned model scores as toxic. Labels come from
    the table ``labels``; a document without a label is scored all the same."""
    model = learn_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model, score="__score")
    return scored.filter(F.col("__score") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the
    smallest id. Documents without shingles or without an id stay. Texts are not
    shuffled while the ids that go are few enough to be sent to all tasks."""
    dropped = stage(near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
                    .agg(F.max("kept").alias("__k")).filter("NOT __k").select("__id"), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= SENT_IDS else dropped
    chosen = docs.join(side, F.col("doc_id") == F.col("__id"), "left_anti")
    # rows that repeat an id and its text count as copies: one of them stays
    repeated = stage(chosen.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id"))
                     .agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1").select("__id"), "repeated")
    if repeated.isEmpty():
        return chosen
    same = F.col("doc_id") == F.col("__id")
    order = W.partitionBy("doc_id", F.md5("text")).orderBy(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    first = (chosen.join(repeated, same, "left_semi").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n"))
    return chosen.join(repeated, same, "left_anti").unionByName(first)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents kept, placed in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: learned models and token ids are out of SQL's reach; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
