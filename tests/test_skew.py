"""A document holding a third of all rows goes through the salted path and
gives the same edges as a brute-force count."""

from collections import Counter
from itertools import combinations

from landscape.operators import indicators as I


def test_hot_document_collaboration_edges(spark):
    rows = [("hot", f"org{i:03d}") for i in range(90)]                     # one mega-document
    rows += [(f"d{j}", f"org{(j * 7 + k) % 120:03d}") for j in range(60) for k in range(3)]
    rows += [("hot", "org000")] * 5                                         # duplicate mentions
    df = spark.createDataFrame(rows, "id string, org string")
    got = {(r["org_1"], r["org_2"]): r["n_docs"] for r in I.collaboration_edges(df, chunk=8).collect()}
    docs = {}
    for d, o in rows:
        docs.setdefault(d, set()).add(o)
    want = Counter(p for orgs in docs.values() for p in combinations(sorted(orgs), 2))
    assert got == dict(want)
