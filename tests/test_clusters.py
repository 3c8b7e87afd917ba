"""Invariants of the embedding estimators, and label bookkeeping."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landscape.operators import clusters as C
from landscape.operators.validation import distances_to_mean


@pytest.fixture(scope="module")
def blobs():
    """Six blobs around two far centres, of unequal scale per dimension."""
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0], [0, 4, 0], [4, 0, 0], [60, 0, 5], [60, 4, 5], [64, 0, 5]], float)
    return np.concatenate([c + rng.normal(0, [0.2, 0.3, 0.1], (20, 3)) for c in centres])


@pytest.fixture(scope="module")
def emb(spark, blobs):
    return spark.createDataFrame([(f"e{i:03d}", v.tolist()) for i, v in enumerate(blobs)],
                                 "entity string, embedding array<double>").cache()


def _by(df, *cols):
    return {r.entity: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_flat_points_lie_nearest_to_their_own_mean(emb, blobs):
    lab = _by(C.kmeans_flat(emb, 6), "cluster")
    names = sorted(set(lab.values()))
    own = np.array([names.index(lab[f"e{i:03d}"]) for i in range(len(blobs))])
    means = np.array([blobs[own == k].mean(0) for k in range(len(names))])
    assert (((blobs[:, None] - means) ** 2).sum(2).argmin(1) == own).all()


def test_inertia_falls_with_more_clusters(emb, blobs):
    def inertia(k):
        lab = _by(C.kmeans_flat(emb, k), "cluster")
        own = np.array([lab[f"e{i:03d}"] for i in range(len(blobs))])
        return sum(((blobs[own == c] - blobs[own == c].mean(0)) ** 2).sum() for c in set(own))
    assert ((blobs - blobs.mean(0)) ** 2).sum() > inertia(2) > inertia(6)
    long = C.fuzzy_multi_resolution(emb, [2, 6])
    assert {(r.level, r["count"]) for r in long.groupBy("level").count().collect()} == {(1, 120), (2, 120)}


def test_hierarchies_are_nested(emb):
    up = _by(C.kmeans_centroid_hierarchy(emb, [6, 2]), "Level_1", "Level_2")
    assert len({fine for _, fine in up.values()}) == len(set(up.values()))  # a fine label has one parent
    cuts = _by(C.bisecting_hierarchy(emb, [2, 4]), "Level_1", "Level_2")
    assert len({fine for _, fine in cuts.values()}) == len(set(cuts.values()))
    assert len({cuts[f"e{i:03d}"][0] for i in range(60)}) == 1


def test_whitening_centres_and_scales(emb, blobs):
    for share, wanted in ((0.5, 1), (0.9999999, 3)):
        x = np.array(list(_by(C.pca_reduce(emb, share), "embedding").values()))
        assert x.shape == (120, wanted)
        assert np.abs(x.mean(0)).max() < 1e-9 and np.abs(np.cov(x.T, ddof=1).reshape(wanted, wanted) - np.eye(wanted)).max() < 1e-9


def test_soft_membership(emb):
    rows = C.gmm_overlap(C.pca_reduce(emb, 0.999), 3, threshold=0.1).collect()
    assert all(0.1 < r.p <= 1.0 + 1e-9 for r in rows)
    for base in {r.entity[:4] for r in rows}:
        own = sorted((r.entity for r in rows if r.entity[:4] == base), key=len)
        assert own == [base, *[f"{base}_{i}" for i in range(2, len(own) + 1)]]


def test_silhouette(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [10.0]), ("d", [11.0])], "entity string, embedding array<double>")
    labels = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1"), ("c", "x", "2"), ("d", "x", "2")], "entity string, l1 string, l2 string")
    got = {r.level: r.silhouette for r in C.silhouette_by_level(df, labels, ["l1", "l2"]).collect()}
    # distances: inside 1; to the other pair 10.5 and 9.5 on average
    outer, inner = 1 - 1 / 10.5, 1 - 1 / 9.5
    assert got[1] == 0.0 and abs(got[2] - (outer + inner) / 2) < 1e-9


def test_silhouettes_equal_brute_force(spark):
    """Clusters that reach over blocks, of one member, equal vectors; blocks of several sizes."""
    rng = np.random.default_rng(7)
    rows = [(f"e{i:03d}", rng.normal(size=3).round(1).tolist(), str(i % 3), f"{i % 2}", f"{rng.integers(0, 9)}") for i in range(90)]
    rows += [("one", [5.0, 5.0, 5.0], "9", "0", "0"), ("two", rows[0][1], rows[0][2], "x", "y")]
    emb = spark.createDataFrame([r[:2] for r in rows], "entity string, embedding array<double>")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "entity string, a string, b string, c string")
    v = np.array([r[1] for r in rows])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for block in (7, 1024):
        got = {r.level: r.silhouette for r in C.silhouette_by_level(emb, labels, ["a", "b", "c"], block).collect()}
        for level in (1, 2, 3):
            path = np.array(["_".join(r[2:2 + level]) for r in rows])
            score = []
            for i, p in enumerate(path):
                own = (path == p) & (np.arange(len(rows)) != i)
                b = min(d[i, path == q].mean() for q in set(path) - {p})
                a = d[i, own].mean() if own.any() else None
                score.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
            assert abs(got[level] - np.mean(score)) < 1e-9


@pytest.mark.parametrize("spans", [1, 2, 5])
def test_silhouettes_over_spans(spark, monkeypatch, spans):
    """Several blocks in a span, with clusters of all lengths: the same values, and what leaves the
    tasks grows with the spans, not with the blocks."""
    from landscape.operators import blocked as B
    rng = np.random.default_rng(3)
    rows = [(f"e{i:03d}", rng.normal(size=4).tolist(), str(i % 2), f"{i % 2}_{i % 7}", f"{i % 2}_{i % 7}_{rng.integers(0, 12)}") for i in range(150)]
    points = spark.createDataFrame(rows, "entity string, v array<double>, a string, b string, c string")
    want = {r.level: r.silhouette for r in B.silhouettes(points, ["a", "b", "c"], 1000).collect()}
    monkeypatch.setattr(B, "SPANS", spans)
    together, made = B._together, []
    monkeypatch.setattr(B, "_together", lambda blocks, pairs: made.append(blocks.count()) or together(blocks, pairs))
    got = {r.level: r.silhouette for r in B.silhouettes(points, ["a", "b", "c"], 6).collect()}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in (1, 2, 3)) and made == [25 * spans]


def test_dendrogram_equals_brute_force_single_linkage(spark):
    """Closest clusters merged one after the other, ties as the tree orders them; cuts nested; more clusters than points."""
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(30, 2)) + 6, rng.integers(0, 3, (12, 2)) * 1.0])
    df = spark.createDataFrame([(f"e{i:02d}", x.tolist()) for i, x in enumerate(v)], "entity string, embedding array<double>")
    ks = [1, 2, 3, 7, 20]
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    edges = sorted((d[i, j], i, j) for i in range(len(v)) for j in range(i + 1, len(v)))
    for block in (9, 1024):
        got = {r.entity: list(r)[1:] for r in C.dendrogram_hierarchy(df, ks, block).collect()}
        for n, k in enumerate(ks):
            label, left = list(range(len(v))), len(v)
            for _, i, j in edges:
                if left > k and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label, left = [a if x == b else x for x in label], left - 1
            assert {e: c[n] for e, c in got.items()} == {f"e{i:02d}": f"e{c:02d}" for i, c in enumerate(label)}
    few = C.dendrogram_hierarchy(df.limit(2), [1, 5]).collect()
    assert len({r.Level_1 for r in few}) == 1 and len({r.Level_2 for r in few}) == 2
    assert C.dendrogram_hierarchy(df.limit(0), [3]).count() == 0


def test_joint_loop_converges_below_mllib(emb, blobs):
    """All configurations together: the same clusters as alone, none moving any more,
    inertia not above MLlib's."""
    from pyspark.ml.clustering import KMeans
    report = []
    configs = {"a": (3, 1), "b": (6, 1), "c": (6, 2), "d": (200, 1)}
    rows = C.kmeans_grid(emb, configs, report).collect()
    assert {r["config"] for r in report} == set(configs) and all(r["converged"] for r in report)
    v = {r.entity: np.array(r.embedding) for r in emb.collect()}
    for name, (k, seed) in configs.items():
        label = {r.entity: r.cluster for r in rows if r.config == name}
        assert set(label) == set(v) and len(set(label.values())) == min(k, len(v))
        centre = {c: np.mean([v[e] for e in v if label[e] == c], axis=0) for c in set(label.values())}
        inertia = sum(((v[e] - centre[label[e]]) ** 2).sum() for e in v)
        nearest = {e: min(centre, key=lambda c: ((x - centre[c]) ** 2).sum()) for e, x in v.items()}
        assert all(((v[e] - centre[nearest[e]]) ** 2).sum() >= ((v[e] - centre[label[e]]) ** 2).sum() - 1e-9 for e in v)
        own = next(r["inertia"] for r in report if r["config"] == name)
        assert abs(own - inertia) <= 1e-6 * max(1, inertia)
        if k < 100:
            assert inertia <= KMeans(k=k, seed=seed, maxIter=100).fit(C.vectors(emb)).summary.trainingCost * (1 + 1e-6)
    alone = {r.entity: r.cluster for r in C.kmeans_flat(emb, 6, 2).collect()}
    assert alone == {r.entity: r.cluster for r in rows if r.config == "c"}
    assert C.kmeans_flat(emb.limit(0), 3).count() == 0


def test_model_selection_grid(emb):
    rows = C.gmm_model_selection(emb, [2, 3], [1, 2]).collect()
    assert {(r.dimensions, r.k) for r in rows} == {(1, 2), (1, 3), (2, 2), (2, 3)}
    assert all(r.bic > r.aic for r in rows)
    assert C.scaled_k(20, 0.25) == 5 and C.scaled_k(3, 0.1) == 2


def test_param_grid():
    assert C.param_grid({"k": [1, 2], "s": [3]}) == [{"k": 1, "s": 3}, {"k": 2, "s": 3}]


def test_kmeans_nested_recovers_blobs_per_parent(spark):
    rows = []
    for parent, base in (("p0", 0.0), ("p1", 100.0)):
        for blob, off in ((0, 0.0), (1, 10.0)):
            for i in range(12):
                rows.append((f"{parent}_{blob}_{i:02d}", parent, [base + off + 0.01 * i, base - off]))
    rows.append(("tiny_0", "tiny", [1.0, 1.0]))  # parent below the size floor passes through
    df = spark.createDataFrame(rows, "entity string, parent string, embedding array<double>")
    for imbalanced, k in ((False, 2), (True, 4)):
        out = _by(C.kmeans_nested(df, k, imbalanced=imbalanced), "parent", "cluster")
        assert out["tiny_0"] == ("tiny", "") and len(out) == 49
        for parent in ("p0", "p1"):
            labels = {b: {out[f"{parent}_{b}_{i:02d}"][1] for i in range(12)} for b in (0, 1)}
            assert len(labels[0]) == 1 and len(labels[1]) == 1 and labels[0] != labels[1]
    sizes = {r.parent: (r.n, r.kp) for r in C.nested_k(df, 4, imbalanced=True).collect()}
    assert sizes == {"p0": (24, 2), "p1": (24, 2), "tiny": (1, None)}


def test_nested_ends_where_nothing_moves(emb, blobs):
    pts = emb.withColumn("parent", F.when(F.substring("entity", 2, 3).cast("int") < 60, "a").otherwise("b"))
    out = _by(C.kmeans_nested(pts, 3), "parent", "cluster")
    own = np.array(["".join(out[f"e{i:03d}"]) for i in range(len(blobs))])
    for parent in "ab":
        names = [n for n in sorted(set(own)) if n[0] == parent]
        inside = np.array([o[0] == parent for o in own])
        means = np.array([blobs[own == n].mean(0) for n in names])
        near = ((blobs[inside][:, None] - means) ** 2).sum(2).argmin(1)
        assert [names[i] for i in near] == own[inside].tolist()


def test_distance_to_mean_is_null_for_one_embedding(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.0, 0.0]), ("c", [5.0, 5.0])], "entity string, embedding array<double>")
    lab = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u"), ("missing", "u")], "entity string, topic string")
    assert _by(distances_to_mean(lab, df, ["topic"]), "distance") == {"a": 1.0, "b": 1.0, "c": None}


def test_normalise_centroid_ids(spark):
    df = spark.createDataFrame(
        [("a", "ce3", "ce10"), ("b", "ce3", "ce17"), ("c", "ce9", "ce5")], "entity string, L1 string, L2 string")
    got = {r["entity"]: (r["L1"], r["L2"]) for r in C.normalise_centroid_ids(df, ["L1", "L2"]).collect()}
    # parent 3 has children 10, 17 -> 0, 1; parent 9 has a single child -> empty label
    assert got == {"a": ("0", "0_0"), "b": ("0", "0_1"), "c": ("1", "1")}


def _counted(spark, df):
    """The rows, and how many have been made of them so far."""
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    return df.mapInArrow(one, df.schema), made


def test_loops_read_their_points_once(spark, emb):
    """However many rounds: what lies before the points is not computed again."""
    report = []
    df, made = _counted(spark, emb)
    assert C.kmeans_grid(df, {"a": (3, 1), "b": (6, 2)}, report).count() == 240
    assert made.value == 120 and max(r["rounds"] for r in report) > 1


def test_nested_loop_reads_its_points_once(spark, emb):
    pts = emb.withColumn("parent", F.when(F.substring("entity", 2, 3).cast("int") < 60, "a").otherwise("b"))
    df, made = _counted(spark, pts)
    assert C.kmeans_nested(df, 3).count() == 120
    assert made.value == 120


def test_packed_points(spark):
    """Every point under its own key, a null key too, in rows of bounded length."""
    from landscape.operators import lloyd as L
    rows = [("a", [float(i), 1.0]) for i in range(L.ROWS + 3)] + [(None, [-1.0, 0.5]), ("b", [2.0, 3.0])]
    df = spark.createDataFrame(rows, "parent string, v array<double>").coalesce(1).sortWithinPartitions("parent")
    got = [(r.parent, L.unpacked(r.n, r.v).tolist()) for r in L.packed(df, "parent").collect()]
    assert sorted((str(p), v) for p, vs in got for v in vs) == sorted((str(p), v) for p, v in rows)
    assert max(len(vs) for _, vs in got) <= L.ROWS and {p for p, _ in got} == {"a", "b", None}


def test_spanning_tree_meets_all_points_once(spark, monkeypatch):
    """Lists of neighbours serve all rounds: points that look at all others again are
    few. With copies and ties, the lengths are those of Prim's tree."""
    from landscape.operators import blocked as B
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(150, 3)), rng.integers(0, 2, (30, 3)) * 1.0, rng.normal(size=(60, 3)) + 9])
    df = spark.createDataFrame([(f"e{i:03d}", x.tolist()) for i, x in enumerate(v)], "entity string, v array<double>")
    asked, lists = [], B._nearest_lists

    def counted(points, *rest):
        asked.append(points.count())
        return lists(points, *rest)

    monkeypatch.setattr(B, "_nearest_lists", counted)
    got = sorted(r.distance for r in B.spanning_tree(df, 8)[1].collect())
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    near, inside, want = d[0].copy(), np.arange(len(v)) == 0, []
    while not inside.all():
        i = np.where(inside, np.inf, near).argmin()
        want.append(near[i])
        inside[i], near = True, np.minimum(near, d[i])
    assert np.allclose(got, sorted(want)) and asked[0] < len(v) and sum(asked[1:]) <= len(v) / 2
