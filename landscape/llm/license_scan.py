"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text is hashed and joined to the k-grams of
the license templates (a small literal table). A match at text position p and
template position t votes for diagonal p - t of its template. Votes are
counted per (text, template, diagonal); neighbouring diagonals (a word
inserted or lost) are merged; a merged span is verified by the share of the
template's k-grams it holds. Hash matches are confirmed on the words
themselves, so a phrase whose k-grams all vote for one diagonal stands there
word for word.

Texts never cross a shuffle: words are joined and counted in the scanning
task, and only vote counts are exchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: runs of letters, digits and non-ASCII characters (upper-case ASCII included: words are lowered later)
WORDS = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # a phrase must stand word for word; others may deviate


# Phrases and labels of the base result.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# Notices of common public licenses (opening sentences or usual one-line forms).
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this "
             "software and associated documentation files the software to deal in the software without restriction"),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are "
             "permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
             "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy "
             "modify publish use compile sell or distribute this software"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse "
             "public license 2 0"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide "
             "under copyright law"),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
             "software and accompanying documentation covered by this license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors "
             "be held liable for any damages arising from the use of this software"),
)


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _grams(words: Column) -> Column:
    """Hash of each word with its successor (the last word's successor is null)."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                      lambda a, b: F.xxhash64(F.lower(a), F.lower(b)))


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(gram, tid, label, phrase, tpos, w0, w1, grams): one row per template
    k-gram; as many rows as the templates have words, whatever the data."""
    rows = ", ".join(f"({i}, '{t.label}', {str(t.phrase).lower()}, '{t.text}')" for i, t in enumerate(templates))
    base = spark.sql(f"SELECT * FROM VALUES {rows} AS t(tid, label, phrase, text)")
    words = base.withColumn("w", F.regexp_extract_all("text", F.lit(WORDS), F.lit(1)))
    return (words.select("tid", "label", "phrase", "w", (F.size("w") - (K - 1)).alias("grams"),
                         F.posexplode(_grams(F.col("w"))).alias("tpos", "gram"))
            .filter("tpos < grams")
            .select("gram", "tid", "label", "phrase", "grams", "tpos",
                    F.expr("get(w, tpos)").alias("w0"), F.expr("get(w, tpos + 1)").alias("w1")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  templates: tuple[Template, ...] = PHRASES + NOTICES,
                  drift: int = 2, coverage: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_base`` (places of
    phrases), ``first_word`` and ``last_word`` (their smallest and largest
    start, null without a place), ``base_labels``, ``labels`` (sorted,
    comma-joined, empty when there are none), ``score`` (largest share of a
    template found, 0 when none is accepted) and ``spans`` (array of accepted
    places: label, first and last word, share).

    Diagonals at most ``drift`` apart merge; a notice is accepted when its
    merged span holds ``coverage`` of its k-grams within at most ``drift`` words
    per ten more than its length. Null text counts as empty: 0 words, no
    labels. A null id is kept as null; repeated rows give one row each; an
    empty table gives no rows; other columns are ignored. A notice that contains
    another one but for a word or two carries the labels of both (BY-SA is BY, too).
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words = rows.select("row", "id", F.regexp_extract_all("text", F.lit(WORDS), F.lit(1)).alias("words"))
    grams = words.select("row", "id", "words", F.size("words").cast("long").alias("n_words"),
                         _grams(F.col("words")).alias("grams_"))
    every = grams.select("row", "id", "n_words", "words", F.posexplode_outer("grams_").alias("pos", "gram"))
    table = F.broadcast(template_grams(spark, templates))  # bounded by the template parameter
    met = every.join(table, "gram", "left")
    same = (F.col("tid").isNotNull() & (lowered(F.expr("get(words, pos)")) == F.col("w0"))
            & (lowered(F.expr("get(words, pos + 1)")) == F.col("w1")))
    diag = F.when(same, (F.col("pos") - F.col("tpos")).cast("long"))  # null: the hash met, the words differ
    met = met.select("row", "id", "n_words", "tpos", diag.alias("diag"), "tid", "label", "phrase", "grams")
    votes = (met.groupBy("row", "id", "n_words", "tid", "label", "phrase", "grams", "diag")
             .agg(F.count("diag").alias("votes"), F.min("tpos").alias("t0"), F.max("tpos").alias("t1")))

    order = W.partitionBy("row", "tid").orderBy("diag")
    apart = F.coalesce((F.col("diag") - F.lag("diag").over(order)) > drift, F.lit(False))
    merged = (votes.withColumn("apart", apart.cast("int"))
              .withColumn("span", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0))))
    place = F.expr("CASE WHEN phrase AND votes = grams THEN diag END")
    spans = (merged.groupBy("row", "id", "n_words", "tid", "label", "phrase", "grams", "span")
             .agg(F.sum("votes").alias("votes"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
                  F.min(F.expr("diag + t0")).alias("w0"), F.max(F.expr("diag + t1")).alias("w1"),
                  F.count(place).alias("places"), F.min(place).alias("first"), F.max(place).alias("last")))
    share = F.expr("least(votes, t1 - t0 + 1) / grams")
    spans = (spans.withColumn("share", F.when(F.col("phrase"), F.expr("if(places > 0, 1.0D, 0.0D)")).otherwise(share))
             .withColumn("ok", F.coalesce(F.when(F.col("phrase"), F.expr("places > 0")).otherwise(
                 (F.col("share") >= coverage)
                 & (F.expr("w1 - w0") < F.col("grams") + F.ceil(F.col("grams") * drift / 10.0))), F.lit(False))))

    def joined(which: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.expr(f"CASE WHEN {which} THEN label END"))), ",")

    return (spans.groupBy("row", "id", "n_words")
            .agg(F.sum("places").cast("long").alias("n_base"), F.min("first").alias("first_word"),
                 F.max("last").alias("last_word"), joined("ok AND phrase").alias("base_labels"),
                 joined("ok").alias("labels"),
                 F.coalesce(F.max(F.expr("CASE WHEN ok THEN share END")), F.lit(0.0)).alias("score"),
                 F.array_sort(F.collect_list(F.expr(
                     "CASE WHEN ok THEN struct(label, if(phrase, first, w0) AS first_word, "
                     f"if(phrase, last + grams, w1 + {K - 1}) AS last_word, share) END"))).alias("spans"))
            .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                    "base_labels", "labels", "score", "spans"))
