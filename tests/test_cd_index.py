"""CD index through the heavy-light plan against a brute-force count."""

import random

from pyspark.sql import functions as F

from landscape.operators import indicators as I


def brute(edges):
    cited_by, refs = {}, {}
    for c, r in set(edges):
        cited_by.setdefault(r, set()).add(c)
        refs.setdefault(c, set()).add(r)
    out = {}
    for f in set(cited_by) | set(refs):
        a = cited_by.get(f, set())
        b = set().union(*[cited_by[r] for r in refs.get(f, ())]) - {f}
        if a | b:
            out[f] = (len(a - b), len(a & b), len(b - a))
    return out


def test_a_reference_cited_by_half_of_all_works(spark):
    """Two references cited by half of all works, a heavy one that cites the others,
    works whose only references are heavy, light chains, a citation of itself."""
    rng = random.Random(4)
    n = 400
    edges = [(w, 1000) for w in range(n) if w % 2] + [(w, 1001) for w in range(n) if rng.random() < 0.5]
    edges += [(w, 1002) for w in range(0, n, 3)] + [(1002, 1000), (1002, 1001), (1001, 1000), (1000, 2000), (5, 5)]
    edges += [(w, rng.randrange(w)) for w in range(1, n) for _ in range(rng.randint(0, 3))]
    edges += edges[:50]
    df = spark.createDataFrame(edges, "citing long, cited long").repartition(6)
    want = brute(edges)
    for heavy in (20, 100, 10 ** 6):
        got = {r.work_id: (r.n_only_focal, r.n_both, r.n_only_refs) for r in I.cd_index(df, heavy).collect()}
        assert got == want
    scores = {r.work_id: r.cd_score for r in I.cd_index(df, 20).collect()}
    assert all(abs(scores[f] - (i - j) / (i + j + k)) < 1e-12 for f, (i, j, k) in want.items())


def test_no_pairs_of_citers_are_built(spark):
    """Without AQE: a reference cited by 30,000 works costs rows in proportion to them, not to their pairs."""
    edges = spark.range(30_000).select(F.col("id").alias("citing"), F.lit(-1).cast("long").alias("cited"))
    edges = edges.unionByName(spark.range(1, 30_000).select(F.col("id").alias("citing"), (F.col("id") - 1).alias("cited")))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.work_id: (r.n_only_focal, r.n_both, r.n_only_refs) for r in I.cd_index(edges).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(got) == 30_001 and got[-1] == (30_000, 0, 0)
    assert got[0] == (0, 1, 29_998) and got[100] == (0, 1, 29_998) and got[29_999] == (0, 0, 29_999)
