"""Work records are grouped as short keys; structs are built after the last shuffle."""

import datetime

from landscape.sources import nested
from landscape.sources.tables import Tables


def test_short_rows_are_grouped(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = datetime.date(1996, 1, 2)
    table("nation", [(1, "CHAD")], "n_nationkey int, n_name string")
    table("customer", [(1, 1)], "c_custkey long, c_nationkey int")
    table("supplier", [(5, "S5", 1)], "s_suppkey long, s_name string, s_nationkey int")
    table("orders", [(20, 1, "O", day), (21, 1, "F", day), (22, 1, "O", day), (22, 1, "O", day)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date")
    # a line without its supplier is a concept but no authorship; an order twice has its lines twice
    table("lineitem", [(20, 1, 7, 5, 3.0), (20, 2, 8, 99, 4.0), (22, 1, 9, 5, 5.0)],
          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    raw = nested.raw_works(Tables(spark, str(tmp_path)))
    lines = raw._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if "Aggregate [" in x and ("author_position" in x or "wikidata" in x)]
    got = {r.id: r for r in raw.dropDuplicates(["id"]).collect()}
    assert set(got) == {"W20", "W22"}
    assert [a.author.id for a in got["W20"].authorships] == ["A20_1"] and len(got["W22"].authorships) == 2
    assert sorted((c.id, c.score) for c in got["W20"].concepts) == [("e7", "0.8"), ("e8", "0.9")]
    assert sorted(got["W20"].referenced_works) == ["W10", "W5", "W6"] and len(got["W22"].referenced_works) == 3


def test_lines_are_joined_once(spark, tmp_path):
    """Lines meet orders once; suppliers, nations and orders that repeat, and orders of no status, count as ever."""
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    day = datetime.date(1996, 1, 2)
    table("nation", [(1, "CHAD"), (1, "TCHAD")], "n_nationkey int, n_name string")
    table("customer", [(1, 1)], "c_custkey long, c_nationkey int")
    table("supplier", [(5, "S5", 1), (5, "S5b", 1), (6, "S6", None), (None, "S0", 1)], "s_suppkey long, s_name string, s_nationkey int")
    table("orders", [(20, 1, "O", day), (20, 1, None, day), (20, 1, "F", day), (21, 1, "O", day), (22, 1, None, day)],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date")
    table("lineitem", [(20, 1, 7, 5, 3.0), (20, 2, 8, 6, 4.0), (22, 1, 9, 5, 5.0), (21, 1, 9, None, 5.0), (21, 2, None, 5, None)],
          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    raw = nested.raw_works(Tables(spark, str(tmp_path)))
    scans = [x for x in raw._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x and "l_orderkey" in x]
    assert len(scans) == 1
    got = {r.id: r for r in raw.collect()}
    assert set(got) == {"W20", "W21"}  # line 1 of order 20: two suppliers of two nations; a mention for each order of its key but patents
    assert sorted((a.author.id, a.author.display_name, a.raw_affiliation_string) for a in got["W20"].authorships) == [
        ("A20_1", n, n) for n in ("S5", "S5", "S5b", "S5b")]
    assert sorted(c.id for c in got["W20"].concepts) == ["e7", "e7", "e8", "e8"]
    assert {a.author.id for a in got["W21"].authorships} == {"A21_2"} and len(got["W21"].concepts) == 2
