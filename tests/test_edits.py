"""Ordered merges against a loop over the list, pair statistics without pairs."""

import itertools
import random

from landscape.operators import edits as ED
from landscape.operators import graph as G
from landscape.operators import validation as V

LEVELS = [f"Level_{i}" for i in range(1, 6)]


def replay(rows, merges):
    """Each merge over all rows, as they are then."""
    rows = {e: list(v) for e, v in rows.items()}
    for topic, target in merges:
        own = 0 if "_" not in target else 1
        kids = [int(v[own + 1].split("_")[-1]) for v in rows.values() if v[own] == target]
        new = f"{target}_{max(kids, default=-1) + 1}"
        for v in rows.values():
            if v[0 if "_" not in topic else 1] == topic:
                v[:] = [target, new] + [f"{new}_0"] * 3 if own == 0 else [target.split("_")[0], target] + [new] * 3
    return {e: tuple(v) for e, v in rows.items()}


def _taxonomy(rng, n):
    rows = {}
    for i in range(n):
        d, a, t = rng.randrange(4), rng.randrange(3), rng.randrange(3)
        rows[f"e{i}"] = (f"{d}", f"{d}_{a}", f"{d}_{a}_{t}", f"{d}_{a}_{t}_0", f"{d}_{a}_{t}_0_{i % 2}")
    return rows


def test_chained_merges_equal_a_loop(spark):
    rng = random.Random(12)
    rows = _taxonomy(rng, 60)
    df = spark.createDataFrame([(e, *v) for e, v in rows.items()], ["entity", *LEVELS])
    names = [str(d) for d in range(5)] + [f"{d}_{a}" for d in range(4) for a in range(5)]
    for _ in range(12):
        merges = []
        for _ in range(rng.randint(1, 7)):
            topic, target = rng.sample(names, 2)
            # a domain goes under a domain, an area under an area or (as a branch of its own) a domain
            if topic.count("_") >= target.count("_") and not target.startswith(topic + "_"):
                merges.append((topic, target))
        m = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(merges)], "topic string, target string, seq int")
        got = {r.entity: tuple(r)[1:] for r in ED.tax_merge_topics(df, m.repartition(3)).select("entity", *LEVELS).collect()}
        assert got == replay(rows, merges), merges


def test_pair_statistics_build_no_pairs(spark):
    rng = random.Random(3)
    rows = _taxonomy(rng, 40)
    df = spark.createDataFrame([(e, *v) for e, v in rows.items()], ["entity", *LEVELS])
    groups = [(f"g{i % 3}", f"s{i % 2}", f"e{i}") for i in range(50)] + [("alone", "s", "e1"), ("g0", "s0", "e0")]
    gf = spark.createDataFrame(groups, "area string, sub string, entity string")
    want = {}
    for key in {g[:2] for g in groups}:
        own = sorted({e for *k, e in groups if tuple(k) == key and e in rows})
        pairs = list(itertools.combinations(own, 2))
        if pairs:
            want[key] = (sum(len(set(rows[a]) & set(rows[b])) for a, b in pairs) / len(pairs), len(pairs),
                         [sum(rows[a][i] == rows[b][i] for a, b in pairs) for i in range(5)], set(pairs))
    depth = V.pairwise_depth(df, gf, ("area", "sub"))
    assert {(r.area, r["sub"]): (round(r.depth, 9), r.n_pairs) for r in depth.collect()} == {
        k: (round(d, 9), n) for k, (d, n, _, _) in want.items()}
    same = {(r.area, r["sub"], r.level): r.pairs_same_topic for r in V.pairwise_survival(df, gf, ("area", "sub")).collect()}
    assert same == {(*k, i + 1): s for k, (_, _, at, _) in want.items() for i, s in enumerate(at)}
    kept = V.surviving_pairs(df, gf, ("area", "sub")).collect()
    assert {(r.area, r["sub"], r.level, r.entity_1, r.entity_2) for r in kept} == {
        (*k, i + 1, a, b) for k, (_, _, _, pairs) in want.items() for a, b in pairs for i in range(5) if rows[a][i] == rows[b][i]}
    assert {r.entity for r in V.dropped_entities(df, gf, ("area", "sub")).collect()} == {f"e{i}" for i in range(40, 50)}
    for out in (depth, V.pairwise_survival(df, gf, ("area", "sub"))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") <= 3 and "entity_1" not in plan  # groups to the taxonomy (twice in depth), labels to group sizes


def test_threshold_join_leaves_common_labels_alone(spark):
    """A label that all carry is in no prefix of a threshold of two: pairs are built from the rare ones."""
    rows = [(f"e{i:03d}", "all", f"b{i // 2}", f"c{i // 3}") for i in range(120)] + [("x", None, None, "c0"), ("y", "all", None, None)]
    df = spark.createDataFrame(rows, "entity string, a string, b string, c string")
    for least in (1, 2, 3):
        want = {(p[0], q[0]): n for p, q in itertools.combinations(sorted(rows), 2)
                if (n := sum(u is not None and u == v for u, v in zip(p[1:], q[1:]))) >= least}
        for chunk in (7, 2000):
            got = G.label_agreement_edges(df, list("abc"), least, chunk).collect()
            assert len(got) == len(want) and {(r.entity_1, r.entity_2): r.agreement for r in got} == want
