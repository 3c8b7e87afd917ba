"""Results do not depend on partitioning, and the CD index on a hand-worked graph."""

import pytest

from landscape.operators import indicators as I
from landscape.plans.registry import load_all
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"
KEYS = ["document_novelty", "collaboration_edges", "disruption_table", "cooccurrence_edges",
        "citation_request_batches", "topic_density"]


@pytest.mark.parametrize("key", KEYS)
def test_same_result_with_1_and_8_shuffle_partitions(spark, key):
    reg = load_all()
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = reg[key].fn(spark, SF)
            out.append(digest(df.columns, df.collect())[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out[0] == out[1]


def test_cd_index_hand_worked(spark):
    # F cites R1, R2. A cites F only; B cites F and R1; C cites R2 only; D cites R1 and R2.
    edges = [("F", "R1"), ("F", "R2"), ("A", "F"), ("B", "F"), ("B", "R1"), ("C", "R2"), ("D", "R1"), ("D", "R2")]
    df = spark.createDataFrame(edges, "citing string, cited string")
    row = {r["work_id"]: r for r in I.cd_index(df).collect()}["F"]
    # only focal: A; both: B; only references: C, D  ->  (1 - 1) / (1 + 1 + 2) = 0
    assert (row["n_only_focal"], row["n_both"], row["n_only_refs"]) == (1, 1, 2)
    assert row["cd_score"] == 0.0
