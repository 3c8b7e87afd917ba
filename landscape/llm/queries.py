"""Registered queries of the subpackage: each applies one operator to its
whole table and derives the result columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_search import nearest_neighbours
from .chat_format import format_conversations, read_loss, read_turns, text_parts
from .common import read, stage
from .decontamination import contaminated_documents
from .hard_negatives import hard_negatives
from .language_id import identify_languages, learn_languages
from .license_scan import scan_licenses
from .near_dedup import near_duplicates
from .packing import pack_documents
from .piece_sampling import decode_pieces, sample_pieces
from .quality_rules import judge_quality, learn_rules, text_statistics
from .token_alignment import align_tokens, score_links
from .token_counts import count_tokens
from .toxicity import learn_toxicity, score_toxicity

MAX_TOKENS = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {MAX_TOKENS} AS over_limit")


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sample_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = decode_pieces(pieces, model)
    return back.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"),
                       F.xxhash64("pieces").alias("pieces_hash"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: A-Z lowered, everything else as it is
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
inv AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k
  FROM inv x JOIN inv y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 75 * (na + nb - k)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id,
  s.doc_id = coalesce(c, s.doc_id) AS kept
FROM s LEFT JOIN comp ON comp.doc_id = s.doc_id
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = format_conversations(talk.unionByName(probe).withColumn("parts", text_parts(F.col("text"))))
    turns = F.array_join(F.transform(read_turns(F.col("formatted")),
                                     lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read_back = out.select("conv_id", "n_turns", turns.alias("turns"),
                           read_loss(F.col("formatted"), F.col("loss")).alias("loss"),
                           F.length("formatted").cast("long").alias("formatted_chars"))
    return read_back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                            F.length("loss").cast("long").alias("loss_chars"),
                            F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length('<|turn|>' || role || chr(10) || regexp_replace(text,
    '([<\\[])(\\\\*)(\\|[a-z_0-9:]*\\|>|/?s>|/?INST\\]|/?SYS>>)', '\\1\\2\\\\\\3', 'g') || '<|end|>' || chr(10)) AS n FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(n) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM g
"""


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(text_statistics(read(spark, sf_dir, "documents")), "statistics")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    rules = learn_rules(stats.join(labels, "doc_id"), "quality = 0")
    return judge_quality(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _remainder(n: int) -> Column:
    """Learning folds: crc32 of the document id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder(4) == 2
    model = learn_languages(docs.filter(~held_out))
    return identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(5) == 0
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = learn_toxicity(docs, labels)
    scored = score_toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", F.expr("if(score >= 0.5, 1, 0)").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, other AS positive_id, s AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, s AS negative_score
FROM pos JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, other) <= 10
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, place.n FROM place JOIN win USING (n, t)),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return score_links(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece_sampling": op2_sentencepiece_sampling,
    "op3_near_dedup": op3_near_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_chat_format": op5_chat_format,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_decontamination": op12_decontamination,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op3_near_dedup": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_decontamination": OP12_SQL,
}
