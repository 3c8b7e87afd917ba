import pytest
from pyspark.sql import types as T

LONG = "word " * 60_000 + "end"

EDGE_TEXTS = [None, "", "   \n\t ", "a", "Ein Wort", "!!! ??? 123", "x" * 50_000, LONG, "same text here again and again",
              "same text here again and again", "naïve café 漢字 🙂 ▁ <|endoftext|> </s>[INST]", "line\nline\nline\nother"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra
    columns whose names clash with those the operators add."""
    rows = [(i, t, "en", "s", None, 1.5, "x", None) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "text without an id", None, None, None, None, None, None), rows[3], rows[3], rows[0]]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType()),
        T.StructField("text_", T.StringType()), T.StructField("c0", T.StringType())])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    from landscape.llm.common import read
    return lambda table: read(spark, "/root/testdata/sf0.001", table)
