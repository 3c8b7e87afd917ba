"""Simulation runs: ratios parsed from names, samples nested in the taxonomy."""

from pyspark.sql import functions as F

from landscape.plans.registry import load_all

SF = "/root/testdata/sf0.001"


def test_runs_are_taxonomy_samples(spark):
    reg = load_all()
    runs = reg["read_simulation_runs"].fn(spark, SF)
    from landscape.plans.registry import tables
    tax = tables(spark, SF).taxonomy
    assert runs.join(tax, ["entity"] + [f"Level_{i}" for i in range(1, 6)], "left_anti").count() == 0
    ratios = {r["ratio"] for r in runs.select("ratio").distinct().collect()}
    assert ratios == {"10", "25", "50"}
    n = tax.count()
    by = {r["run"]: r["count"] for r in runs.groupBy("run").count().collect()}
    for run, c in by.items():
        ratio = int(run.split("_")[2])
        assert abs(c / n - ratio / 100) < 0.15


def test_query_sizes_sum_to_run_sizes(spark):
    reg = load_all()
    sizes = reg["query_sizes"].fn(spark, SF)
    runs = reg["read_simulation_runs"].fn(spark, SF)
    lvl1 = sizes.where(F.col("level").startswith("Level_1")).groupBy("run").agg(F.sum("size").alias("s"))
    counts = runs.where(F.col("ratio").isin("10", "25")).groupBy("run").count()
    got = {r["run"]: r["s"] for r in lvl1.collect()}
    want = {r["run"]: r["count"] for r in counts.collect()}
    assert got == want
