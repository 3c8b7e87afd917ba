import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from landscape.llm import queries
from landscape.llm.decontamination import WindowParams, contaminated_documents, item_windows, window_shingles

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """(words, hit words, items, runs) of each document, place by place."""
    out = []
    wins = [(str(i), tuple(w[s:s + window])) for i, t in items if i is not None for w in [words(t)] if w
            for s in range(max(1, len(w) - window + 1))]
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s:s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def result(docs, items, **params):
    rows = contaminated_documents(docs, items, params=WindowParams(**params)).collect()
    for r in rows:
        assert sum(s.stop - s.first for s in r.spans) == r.n_hit
        assert all(a.stop < b.first for a, b in zip(r.spans, r.spans[1:]))
    return sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows], key=str)


@pytest.mark.parametrize("params", [{}, {"window": 4, "k": 3}, {"window": 3, "k": 1, "map_bits": 12}])
def test_equals_brute_force(spark, params):
    """A small vocabulary: shingles that are frequent, overlap and repeat; short and equal items."""
    rng = random.Random(9)
    pool = ["Alpha", "beta", "GAMMA", "δέλτα", "É", "x1", "K"]

    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 4, 8, 12, 15]))) for i in range(25)]
    items += [(90, items[0][1]), (91, "..."), (92, None), (93, ""), (None, "alpha beta gamma")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)]
    docs += [(200 + i, text(5) + t + text(3) + t.upper()) for i, t in items[:25] if i is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(df, bench, **params) == brute(docs, items, params.get("window", 10))


def test_edges(spark, edge_docs, no_docs):
    items = [(1, "same text here again and again"), (2, "word " * 12), (3, "naïve café"), (1, "line line line other")]
    bench = spark.createDataFrame([(i, t, None, "x") for i, t in items], "item_id long, text string, doc_id long, row string")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect() if len(words(r.text)) < 1000]
    got = result(edge_docs, bench)
    want = brute(docs, items)
    assert [r for r in got if r[1] < 1000] == want
    long = [r for r in got if r[1] >= 1000]  # 60,000 times the word of item 2, and one word more
    assert long == [(7, 60_001, 60_000, ("2",))]
    assert result(no_docs, bench) == [] and [r[2:] for r in result(edge_docs, bench.limit(0))] == [(0, ())] * edge_docs.count()


def test_rarest_shingle_is_the_prefix(spark):
    """A frequent opening does not bring its windows: they are joined on what is rare in the documents."""
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e q q q q q")], "item_id long, text string")
    docs = spark.createDataFrame([(i, "a b c d e z") for i in range(50)] + [(99, "a b c d e f g h i j")], "doc_id long, text string")
    p = WindowParams()
    grams = window_shingles(item_windows(items, "item_id", "text", p), p)
    assert grams.groupBy("wid").count().select(F.max("count")).first()[0] == 6
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in contaminated_documents(docs, items).collect()}
    assert got[99] == (10, ["1"]) and all(got[i] == (0, []) for i in range(50))


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    got = queries.op12_decontamination(spark, "/root/testdata/sf0.001").collect()
    index = {}
    for i, t in items:  # windows looked up by their words
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            index.setdefault(tuple(w[s:s + 10]), set()).add(str(i))
    sizes = {len(x) for x in index}
    want = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s:s + n])) in index:
                    hit |= set(range(s, s + n))
                    found |= index[x]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(tuple(r) for r in got) == sorted(want) and any(r[2] for r in want)
