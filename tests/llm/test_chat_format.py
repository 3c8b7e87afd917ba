import random

import duckdb
from pyspark.sql import functions as F

from landscape.llm import queries
from landscape.llm.chat_format import (CONTROL, PART_TYPE, escape, format_conversations, read_loss, read_turns,
                                       text_parts, unescape)
from tools.check_oracle import digest


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    rel = con.sql(queries.OP5_SQL)
    df = queries.op5_chat_format(spark, "/root/testdata/sf0.01")
    assert digest(df.columns, df.collect())[0] == digest(rel.columns, rel.fetchall())[0]


def test_escape_is_reversible(spark):
    rng = random.Random(3)
    bits = ["<", "[", "\\", "|", "turn", "|>", "s>", "/s>", "/", "INST]", "SYS>>", "<|end|>", "x", "\n", "<|part|>", "<\\|turn|>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    bare = CONTROL.replace(r"(\\*)", "()")
    rows = df.select("t", "e", unescape(F.col("e")).alias("u"), F.col("e").rlike(bare).alias("left")).collect()
    assert all(r.t == r.u for r in rows) and not any(r.left for r in rows)


def test_parts(spark):
    parts = [("text", "Look </s> ", None, None, None, None, None), ("image", None, "a.png", 28, 30, None, None),
             ("text", "<", None, None, None, None, None), ("text", "|turn|> [INST]", None, None, None, None, None),
             ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 1, "assistant", parts), (1, 0, "us%er\nx", parts[:1]), (1, 2, None, None)],
                               f"conv_id long, turn long, role string, parts array<{PART_TYPE}>")
    out = format_conversations(df)
    r = out.select("*", read_turns(F.col("formatted")).alias("turns"),
                   read_loss(F.col("formatted"), F.col("loss")).alias("kept")).first()
    assert [tuple(t) for t in r.turns] == [("us%er\nx", "Look </s> "), ("assistant", "Look </s> <|turn|> [INST]"), ("", "")]
    assert r.kept == "Look </s> <|turn|> [INST]" and r.n_turns == 3
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (1, 1, "image", "a.png", 6), (1, 4, "audio", "b.wav", 38), (1, 5, "document", "c.pdf", 1536)]
    assert r.attachment_tokens == 1580
    assert r.formatted.count("<|turn|>") == 3 and "<|image:1|>" in r.formatted


def test_edges(spark):
    rows = [(None, 0, "user", "no id"), (1, None, "assistant", None), (1, 0, "user", "b"), (1, 0, "user", "b"),
            (2, 5, "assistant", "x" * 100_000), (3, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "formatted", F.lit("clash")).withColumn("parts", text_parts(F.col("text")))
    out = format_conversations(df).select("conv_id", "n_turns", read_turns(F.col("formatted")).alias("t"),
                                          read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 1, 1: 3, 2: 1, 3: 1}
    assert [tuple(t) for t in got[1].t] == [("assistant", ""), ("user", "b"), ("user", "b")]
    assert got[2].loss == "x" * 100_000 and got[3].loss == ""
    assert format_conversations(df.limit(0)).count() == 0
