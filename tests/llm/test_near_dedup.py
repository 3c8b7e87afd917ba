import collections
import random
import re

import duckdb
import pytest

from landscape.llm import queries
from landscape.llm.components import components
from landscape.llm.near_dedup import near_duplicates
from tools.check_oracle import digest

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if sets[a] and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


def edited(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 7 + str(rng.random()) if rng.random() < share else w for w in words)


def test_planted_groups(spark):
    """Copies, near copies of an origin that resemble each other less, chains,
    texts around one shared passage, short texts."""
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        origin = [f"w{rng.random()}" for _ in range(150)]
        texts += [" ".join(origin)] * 5
        texts += [edited(rng, origin, s) for s in (0.005, 0.01, 0.02, 0.02, 0.025, 0.03, 0.03, 0.04, 0.06) for _ in range(4)]
        step = origin
        for _ in range(6):
            step = edited(rng, step, 0.015).split(" ")
            texts.append(" ".join(step))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rng.random()}" for _ in range(n)) for n in (2, 5, 8, 12, 15, 20, 25, 40) * 5]
    texts += ["one", "One", "two words", "two  words", "a b c d", "", None, "  \n"]
    rng.shuffle(texts)
    table = {i * 7 % 1009: t for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    want = brute(table)
    assert result(df) == want
    assert len({c for _, c, _ in want.values()}) < len(want) - 50
    assert result(df.repartition(5)) == want


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    rel = con.sql(queries.OP3_SQL)
    df = queries.op3_near_dedup(spark, "/root/testdata/sf0.001")
    assert digest(df.columns, df.collect())[0] == digest(rel.columns, rel.fetchall())[0]


def test_edges(edge_docs, no_docs):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[None] == {(1, None, True)} and by[0] == {(0, 0, True)} and by[2] == {(0, 2, True)}
    assert by[8] == {(2, 8, True)} and by[9] == {(2, 8, False)}
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 5), (3, 2), (2, 3), (9, 8)], [(1, 1)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long") if edges else spark.createDataFrame([], "u long, v long")
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in components(df).collect()} == root


def test_hub_is_split(spark):
    """A star of 10^5 nodes beside as many lone pairs: no task of the join that
    hands neighbours on reads more than a few times the usual share."""
    from pyspark.sql import functions as F

    from landscape.llm.components import _with_lowest, stage
    n = 100_000
    edges = spark.range(n).selectExpr("0L AS u", "id + 1 AS v").union(spark.range(n).selectExpr(f"id * 2 + {2 * n} AS u", f"id * 2 + {2 * n} + 1 AS v"))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        low = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        parts = _with_lowest(edges, low).groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = sorted(r["count"] for r in parts)
        assert sum(sizes) == 2 * n and sizes[-1] <= 6 * sizes[len(sizes) // 2]
        got = {r.node: r.component for r in components(edges).filter(f"node <= {n}").collect()}
        assert len(got) == n + 1 and set(got.values()) == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
