"""Hand-worked checks of the shared building blocks."""

import math

import numpy as np

from pyspark.sql import functions as F

from landscape.functions.exact import mean6
from landscape.functions.ordering import global_row_number
from landscape.functions.pairs import pairs_within
from landscape.functions.quantiles import nearest, ranges, selected


def test_nearest_quantile_matches_rank_rule(spark):
    vals = [5.0, 1.0, 3.0, 2.0, 4.0, 4.0]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    got = nearest(df, ["k"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, mean="m").collect()[0]
    s = sorted(vals)
    for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert got[name] == s[math.floor((len(s) - 1) * q + 0.5)]
    assert abs(got["m"] - sum(vals) / len(vals)) < 1e-12


def test_pairs_within_salting_is_exact(spark):
    rows = [("hot", f"o{i:03d}") for i in range(60)] + [("cold", "a"), ("cold", "b"), ("cold", "c")]
    df = spark.createDataFrame(rows, "doc string, org string")
    plain = {tuple(r) for r in pairs_within(df, ["doc"], "org", chunk=10_000).collect()}
    salted = pairs_within(df, ["doc"], "org", chunk=7).collect()  # hot doc split into 9 buckets
    assert len(salted) == len(set(map(tuple, salted)))
    assert {tuple(r) for r in salted} == plain
    assert len(plain) == 60 * 59 // 2 + 3


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 1000)
    rows = global_row_number(df.repartition(5), ["k", "id"]).orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, 1001))
    keys = [(r["k"], r["id"]) for r in rows]
    assert keys == sorted(keys)


def test_mean6_rounds_ties_half_away(spark):
    df = spark.createDataFrame([(0.001,), (0.002,), (0.0,), (0.0,)] * 1 + [(-0.0126875 * 0,)], "v double")
    # mean of 0.001, 0.002, 0, 0, 0 = 0.0006 exactly
    assert df.agg(mean6("v").alias("m")).collect()[0]["m"] == 0.0006
    tie = spark.createDataFrame([(0.001,), (0.0,)] * 1 + [(0.0,)] * 6, "v double")  # 0.001/8 = 0.000125
    assert tie.agg(mean6("v").alias("m")).collect()[0]["m"] == 0.000125


def test_quantiles_of_cut_groups(spark):
    """Groups cut into ranges give what whole ones give; null keys and null values, ties, a constant group."""
    rng = np.random.default_rng(3)
    rows = [("hot", None, float(v)) for v in rng.normal(size=900).round(2)] + [("flat", 1, 2.0)] * 60
    rows += [(None, 2, float(v)) for v in rng.exponential(size=70)] + [("few", 3, 1.0), ("few", 3, None), ("none", 4, None)]
    df = spark.createDataFrame(rows, "k string, y int, v double").repartition(6)
    groups = {}
    for k, y, v in rows:
        if v is not None:
            groups.setdefault((k, y), []).append(v)
    qs = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    for large in (5, 10 ** 9):
        got = {(r.k, r.y): r for r in selected(df, ["k", "y"], "v", qs, "linear", "m", large).collect()}
        assert set(got) == set(groups)
        for g, vals in groups.items():
            assert np.allclose([got[g][n] for n in qs], np.quantile(vals, list(qs.values()))) and abs(got[g].m - np.mean(vals)) < 1e-9
        near = {(r.k, r.y): r for r in selected(df, ["k", "y"], "v", qs, "nearest", None, large).collect()}
        for g, vals in groups.items():
            s = sorted(vals)
            assert [near[g][n] for n in qs] == [s[math.floor((len(s) - 1) * q + 0.5)] for q in qs.values()]


def test_a_hot_group_is_spread(spark):
    """One group with nine tenths of the rows: its ranges are small next to the group, and so are the parts that rows meet in."""
    df = spark.range(200_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 200)).alias("k"),
                                     F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    sizes = ranges(df, ["k"], "v", large=5_000).groupBy("k", "_r").count().where("k = 'hot'").collect()
    assert len(sizes) == 64 and max(r["count"] for r in sizes) <= 2 * 180_000 / 64
    ordered = ranges(df, ["k"], "v", large=5_000).repartition(32, "k", "_r").groupBy(F.spark_partition_id()).count().collect()
    counts = sorted(r["count"] for r in ordered)
    assert counts[-1] <= 4 * counts[len(counts) // 2]
