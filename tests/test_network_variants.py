import __spark_entry__ as ent

SF = "/root/testdata/sf0.01"


def test_every_organisation_and_level(spark):
    """100 organisations: the top 50 lose half of them, the 500 none."""
    q = ent.queries()
    orgs = q["docs_per_org"](spark, SF).count()
    assert 50 < orgs <= 500 and q["collaboration_nodes_500"](spark, SF).count() == orgs
    assert q["collaboration_network_500"](spark, SF).count() == q["collaboration_edges"](spark, SF).count()
    levels = {"domain", "area", "topic"}
    assert {r.level for r in q["org_topics_by_level"](spark, SF).select("level").distinct().collect()} == levels
    assert {r.level for r in q["collaboration_edges_by_level"](spark, SF).select("level").distinct().collect()} == levels
    works, patents, both = (q[k](spark, SF) for k in ("topic_lookup_works", "topic_lookup", "topic_lookup_both"))
    assert {r.topic for r in both.collect()} == {r.topic for r in works.collect()} | {r.topic for r in patents.collect()}


def test_edges_by_topic_are_of_all_levels(spark):
    """Domains, areas and topics; an edge of a topic is one of its area and its domain, too."""
    rows = ent.queries()["collaboration_edges_by_topic"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.level, r.area is None, r.topic is None) for r in rows} == {
        ("domain", True, True), ("area", False, True), ("topic", False, False)}
    held = {(r.level, r.domain, r.area, r.topic, r.org_1, r.org_2): r.n_docs for r in rows}
    assert len(held) == len(rows) and {r.present for r in rows} == {1}
    for (level, domain, area, topic, a, b), n in held.items():
        if level == "topic":
            assert topic.startswith(f"{area}_") and area.startswith(f"{domain}_")
            assert held["area", domain, area, None, a, b] >= n and held["domain", domain, None, None, a, b] >= n
