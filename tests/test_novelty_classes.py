"""Novelty is computed once for documents of the same year and topics."""

import math
from collections import Counter
from itertools import combinations

import numpy as np

import pytest

from landscape.operators import indicators as I
from landscape.operators import novelty as N


def test_novelty_by_classes(spark):
    kinds = [(1990, "ab"), (1990, "abc"), (1991, "ab"), (1991, "bcd"), (1991, "ad")]
    docs = [(1, f"W{i}", *kinds[i * i % 5]) for i in range(60)]
    df = spark.createDataFrame([(lv, d, y, len(t), list(t)) for lv, d, y, t in docs],
                               "level int, work_id string, year int, n_topics int, topics array<string>")
    out = N.document_novelty(df, by=["level"])
    # no row is made, moved or grouped for a pair of a document
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "work_id" in line.split("], [")[0]]
    pair, single, total = Counter(), Counter(), Counter()
    for _, _, y, t in docs:
        for a, b in combinations(t, 2):
            pair[y, a, b] += 1
            single[y, a] += 1
            single[y, b] += 1
            total[y] += 1
    got = {r.work_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for _, d, y, t in docs:
        c = [pair[y, a, b] * total[y] / (single[y, a] * single[y, b]) for a, b in combinations(t, 2)]
        assert abs(got[d].commonness - np.percentile(c, 10)) < 1e-9 and abs(got[d].novelty + math.log(got[d].commonness)) < 1e-9
    long = {(r.work_id, r.topic): r.doc_counts for r in I.novelty_long(out).collect()}
    assert len(long) == sum(len(t) for *_, t in docs) and long["W1", "a"] == sum("a" in t for *_, t in docs)


@pytest.mark.parametrize("sent", [N.SENT_ROWS, 0])
def test_documents_and_pairs_never_pass_the_driver(spark, tmp_path, monkeypatch, sent):
    """Read from a compact file, documents and pairs of classes are estimated far too small: counted
    sides are sent to all tasks, or both are merged; null years and ids, and repeated rows, as ever."""
    docs = [(1, f"W{i % 90}", None if i % 17 == 0 else 1990 + i % 3, list("abcdefg"[i % 5:i % 5 + 2 + i % 2])) for i in range(99)]
    df = spark.createDataFrame([(lv, d, y, len(t), t) for lv, d, y, t in docs] + [(1, None, 1990, 2, ["a", "b"])],
                               "level int, work_id string, year int, n_topics int, topics array<string>")
    df.write.parquet(f"{tmp_path}/docs")
    staged, joins = N._staged, []

    def seen(part, name):
        joins.extend(x for x in part._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "topic_1" in x and "topics" not in x)
        return staged(part, name)

    monkeypatch.setattr(N, "_staged", seen)
    monkeypatch.setattr(N, "SENT_ROWS", sent)
    out = N.document_novelty(spark.read.parquet(f"{tmp_path}/docs"), by=["level"])
    hint = "rightHint=(strategy=broadcast)" if sent else "leftHint=(strategy=merge)"
    assert hint in out._jdf.queryExecution().optimizedPlan().toString() and any(hint in x for x in joins)
    monkeypatch.undo()
    got = sorted((r.work_id, r.year, round(r.commonness, 9)) for r in out.collect())
    assert len(got) == sum(y is not None for _, _, y, _ in docs)
    assert got == sorted((r.work_id, r.year, round(r.commonness, 9)) for r in N.document_novelty(df, by=["level"]).collect())
