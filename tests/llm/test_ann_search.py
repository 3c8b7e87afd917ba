import numpy as np
import pytest

from landscape.llm.ann_search import AnnParams, Hashing, _normal, nearest_neighbours


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def found(df, queries, **kw):
    out = {}
    for r in nearest_neighbours(df, queries, **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_on_embeddings(small):
    df = small("embeddings")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    queries = [i for i in ids if i % 20 == 0]
    got, want = found(df, df.filter("vec_id % 20 = 0")), brute(ids, x, queries, 20)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in queries)
    assert hits >= 0.9 * 20 * len(queries)
    for q in queries:
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        for _, v, s in got[q]:
            assert abs(s - x[ids.index(v)] @ x[ids.index(q)]) < 1e-12
        assert got[q] == sorted(got[q], key=lambda t: (-t[2], t[1]))


def test_norms_copies_and_hot_bucket(spark):
    """Vectors of many lengths, a third of them copies of one; small blocks, so
    that the bins of the hot bucket are split on both sides."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.2, 3, 900)[:, None]
    x[300:600] = x[300]
    ids = [int(i) for i in rng.permutation(5000)[:900]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    queries = sorted(ids)[::15]
    p = AnnParams(rows_per_bin=64, queries_per_block=16, success=0.98)
    got = found(df, df.filter(df.vec_id.isin(queries)), k=10, params=p)
    want = brute(ids, x, queries, 10)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in queries)
    assert set(got) == set(queries) and hits >= 0.9 * 10 * len(queries)
    hot = [q for q in queries if q in set(ids[300:600])]
    assert hot and all([v for _, v, _ in got[q]] == [v for v, _ in want[q]] for q in hot
                       if abs(want[q][0][1] - want[q][9][1]) < 1e-9)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS score", "1 AS bin")
    got = found(df, df)
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == {
        0: [1, 2, 10], 1: [0, 2, 10], 2: [0, 1, 10], 10: [2, 0, 1]}
    assert nearest_neighbours(df.limit(0), df).count() == 0
    assert nearest_neighbours(df, df.limit(0)).count() == 0
    assert nearest_neighbours(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0


@pytest.mark.parametrize("rows", [100, 10_000, 10**7])
def test_probes_come_in_order_of_estimated_success(rows):
    h = Hashing(16, rows, 1.0, AnnParams())
    x = np.random.default_rng(0).normal(size=(5, 16))
    query, key = h.probes(x, 0, 1.0)
    home = h.keys(np.floor(h.places(x, True))[:, 0], 0)
    assert all(home[q] in key[query == q] for q in range(5))
    assert all(len(set(key[query == q])) == (query == q).sum() for q in range(5))


def test_normal_distribution():
    from math import erf
    z = np.linspace(-6, 6, 101)
    assert np.abs(_normal(z) - [0.5 * (1 + erf(v / 2 ** 0.5)) for v in z]).max() < 1e-6


def test_two_hot_groups_and_clusters(spark):
    """Copies and tight clusters make the usual distance collapse; the other
    queries look as far as their own neighbours lie."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[:400], x[400:800] = x[0], x[400]
    x[800:1000] = x[800] + 1e-4 * rng.normal(size=(200, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids = list(range(1500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    queries = ids[::10]
    got, want = found(df, df.filter("vec_id % 10 = 0"), k=10), brute(ids, x, queries, 10)
    alone = [q for q in queries if q >= 1000]
    hits = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in alone]
    assert all(len(got[q]) == 10 for q in queries) and sum(hits) >= 0.93 * 10 * len(alone)


@pytest.mark.parametrize("radius", [1.2, 1.41])
def test_reached_mass_is_reported_at_many_rows(radius):
    x = np.random.default_rng(0).normal(size=(20, 64))
    for rows in (10**4, 10**8):
        h = Hashing(64, rows, 1.0, AnnParams())
        tables, reached = h.visits(x, np.full(20, radius), np.zeros(20))
        missed = np.prod([1 - h.ranked(x, t, np.full(20, radius))[2] for t in range(2)], axis=0)
        assert (reached == (1 - missed >= 0.96 - 1e-5)).all()
        assert all(set(q) == set(np.flatnonzero(reached)) for q, _ in tables)
        assert reached.all() if rows == 10**4 else not reached.all()


def test_second_visit_adds_what_is_missing():
    x = np.random.default_rng(0).normal(size=(6, 16))
    h = Hashing(16, 10**5, 1.0, AnnParams())
    whole, _ = h.visits(x, np.full(6, 1.1), np.zeros(6))
    added, _ = h.visits(x, np.full(6, 1.1), np.full(6, 0.6))
    for t in range(2):
        old = set(zip(*map(np.ndarray.tolist, h.ranked(x, t, np.full(6, 0.6))[:2])))
        every, new = (set(zip(*map(np.ndarray.tolist, v[t]))) for v in (whole, added))
        assert new == every - old


def test_outlier_norm_and_short_beam_are_compared_with_all_rows(spark):
    """One vector of a hundredfold norm lifts all others to it; with few buckets
    ranked no query reaches its probability, and nothing is lost."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[7] *= 100
    ids = list(range(1200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    queries = ids[::20]
    got = found(df, df.filter("vec_id % 20 = 0"), k=10, params=AnnParams(beam=4))
    want = brute(ids, x, queries, 10)
    assert all([v for _, v, _ in got[q]] == [v for v, _ in want[q]] for q in queries)


def test_repeated_ids_count_with_their_largest_score(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, df.filter("vec_id = 1"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2.0), (3, 1.0)]
