"""Organisations of a document meet once, whatever the number of its groups."""

import random
from collections import Counter
from itertools import combinations

from landscape.operators import indicators as I


def test_groups_are_written_out_after_documents_met(spark):
    """Organisations that hold different groups of a document, nulls, repeated rows and documents above the chunk."""
    rng = random.Random(4)
    rows = [(f"d{rng.randrange(12)}", rng.choice(["x", "y", None]), f"t{rng.randrange(3)}", f"o{rng.randrange(9)}") for _ in range(400)]
    rows += [("d0", "x", "t0", None), (None, "x", "t0", "o1"), ("one", "x", "t0", "o1")]
    df = spark.createDataFrame(rows, "id string, level string, name string, org string")
    for chunk in (3, 2000):
        out = I.collaboration_edges(df, by=["level", "name"], chunk=chunk)
        want = Counter()
        for i, level, name in {r[:3] for r in rows if None not in r}:
            orgs = {r[3] for r in rows if r[:3] == (i, level, name) and r[3]}
            want.update((level, name, *p) for p in combinations(sorted(orgs), 2))
        assert {tuple(r[:4]): r.n_docs for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (chunk == 3)  # pairs are made inside documents; only those above the chunk are joined


def test_levels_are_made_inside_documents(spark):
    """Different topics of one area are one shared area; the same edges as from rows of all levels."""
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(9)}", f"{rng.randrange(2)}_{rng.randrange(2)}_{rng.randrange(3)}", f"o{rng.randrange(7)}") for _ in range(90)]
    df = spark.createDataFrame(rows, "id string, topic string, org string")
    got = I.collaboration_edges(df, by="topic", at=I.topic_levels)
    want = I.collaboration_edges(I.by_topic_level(df), by=["level", "name"])
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())
