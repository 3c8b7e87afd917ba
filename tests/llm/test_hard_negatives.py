from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from landscape.llm.hard_negatives import TreeParams, best_first, hard_negatives, packed

ANCHOR = "vec_id % 5 = 0"
SCHEMA = "vec_id long, embedding array<float>, label long, extra string, id long, q string"


def brute(rows, anchor, positives=5, negatives=10):
    """Every anchor against every row; rows: {id: (label, integer vector)}."""
    out = set()
    for a, (label, v) in rows.items():
        if not anchor(a):
            continue
        scored = sorted((-int(np.dot(v, w)), b, other) for b, (other, w) in rows.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(t, n) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out |= {(a, p, i + 1, n, -s, -t) for i, (t, n) in enumerate(found)}
    return out


class Counted(np.ndarray):
    """Counts the slices taken of it."""
    opened = 0

    def __getitem__(self, key):
        Counted.opened += isinstance(key, slice)
        return super().__getitem__(key)


def result(df, anchor=ANCHOR, **params):
    got = [tuple(r) for r in hard_negatives(df, F.expr(anchor), params=TreeParams(**params)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 7, "q") for i, label, v in rows], SCHEMA)


@pytest.mark.parametrize("params", [{}, {"subtree": 40, "leaf": 4, "slabs": 3, "block": 3, "first": 1}])
def test_equals_brute_force(spark, params):
    """Clusters, a third of all rows equal, labels of one row, ties."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)) if i % 50 else 100 + i, (centre[i % 6] + 0.2 * rng.normal(size=8)).round(1)) for i in range(400)]
    rows += [(1000 + i, i % 3, centre[0].round(1)) for i in range(200)]
    rows += [(2000 + i, 1, np.zeros(8)) for i in range(5)]
    whole = {i: (label, np.floor(256 * v.astype(np.float32).astype(float)).astype(int)) for i, label, v in rows}
    df = table(spark, [(i, label, v.tolist()) for i, label, v in rows]).repartition(5)
    assert result(df, **params) == brute(whole, lambda i: i % 5 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 2, [0.5 + i / 10, 1.0 - i / 20]) for i in range(12)]
    odd = [(100, 0, None), (105, None, [1.0, 1.0]), (110, 1, [nan, 1.0]), (115, 1, [inf, 1.0]), (120, 0, [None, 1.0]),
           (125, 0, [1.0]), (130, 0, []), (None, 1, [1.0, 1.0]), good[3], good[5], (7, 0, [9.0, 9.0])]
    whole = {i: (label, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, label, v in good}
    # id 7 repeats with another vector: the larger label counts
    df = table(spark, good + odd)
    want = brute(whole, lambda i: i % 5 == 0)
    assert result(df) == want and want
    assert result(df.limit(0)) == set() and result(df, "false") == set() and result(df.filter("vec_id = 5")) == set()
    assert hard_negatives(df, F.expr(ANCHOR)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_queue_prunes_and_is_exact():
    """On clustered vectors most leaves stay unopened; the answer is that of a full scan."""
    rng = np.random.default_rng(2)
    centre = rng.integers(-200, 200, (40, 16))
    v = (np.repeat(centre, 100, axis=0) + rng.integers(-4, 5, (4000, 16))).astype(float)
    labels, ids = np.repeat(np.arange(40) % 5, 100), np.arange(4000)
    t = packed(ids, labels, v, TreeParams())
    assert sorted(t.ids) == list(ids) and (t.child[:, 1] == 0).sum() >= 4000 // 64
    for q in v[::500]:
        lower, upper = t.boxes.products(q[None])
        inner = [(t.v[a:b] @ q).tolist() for a, b in t.span]
        assert all(lo <= min(x) and max(x) <= hi for lo, hi, x in zip(lower[0], upper[0], inner))
        high = float(np.quantile(v @ q, 0.95))
        windows = np.array([[-np.inf, np.inf, -np.inf], [high / 2, high, -np.inf], [3.0, 1.0, -np.inf]])
        fits = t.boxes.may_match(np.array([1]), False)[0]
        Counted.opened = 0
        best_first(replace(t, v=t.v.view(Counted)), q, -1, 1, False, 10, windows[:1], lower[0], upper[0], fits)
        assert 0 < Counted.opened < 30
        got = best_first(t, q, -1, 1, False, 10, windows, lower[0], upper[0], t.boxes.may_match(np.array([1]), False)[0])
        s = v @ q
        for (low, high, _), (found, score) in zip(windows, got):
            want = sorted((-x, i) for i, x in zip(ids, s) if labels[i] != 1 and low <= x <= high)[:10]
            assert list(zip((-score).tolist(), found.tolist())) == want
