import corpus_pipeline as cp
from landscape.llm.common import read

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read(spark, SF, "documents").cache()
    assert [n for n, _ in cp.STAGES] == ["language", "toxicity", "near_dedup", "packing"]
    columns = docs.columns
    junk = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "123 !!", "en", "s", 6)], docs.schema)
    first = cp.language_stage(spark, docs.unionByName(junk), SF)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()}
    second = cp.toxicity_stage(spark, docs, SF)
    toxic = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in second.collect()}
    assert second.columns == columns
    assert sum(d not in kept for d, t in toxic.items() if t) >= 0.8 * sum(t == 1 for t in toxic.values())
    assert sum(d in kept for d, t in toxic.items() if not t) >= 0.99 * sum(t == 0 for t in toxic.values())
    third = cp.near_dedup_stage(spark, docs, SF)
    assert third.columns == columns and third.count() == 915  # of 1000, by brute force over all pairs


def test_run_follows_the_stages(spark, sf="/root/testdata/sf0.001"):
    docs = read(spark, sf, "documents")
    for _, step in cp.STAGES[:-1]:
        docs = step(spark, docs, sf)
    ids = {r.doc_id for r in docs.collect()}
    rows = cp.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == ids


def test_edges(spark, edge_docs, no_docs):
    for name, step in cp.STAGES[:-1]:
        out = step(spark, edge_docs, SF)
        assert out.columns == edge_docs.columns, name
        assert step(spark, no_docs, SF).count() == 0, name
    rows = cp.near_dedup_stage(spark, edge_docs, SF).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(
        str(i) for i in [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, None])


def test_language_stage_rejects_gibberish(spark):
    import base64
    import hashlib
    import random
    rng = random.Random(6)
    digest = [hashlib.sha256(bytes([i])) for i in range(8)]
    junk = ["".join(d.hexdigest() for d in digest), " ".join(d.hexdigest()[:9] for d in digest),
            base64.b64encode(b"".join(d.digest() for d in digest)).decode(),
            " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(60)),
            "<td class=\"a1\"><br/></td><p style='x:0;y:1'>&nbsp;</p>{};" * 6, "q" * 400,
            "Съешь же ещё этих мягких французских булок да выпей чаю " * 3]
    docs = read(spark, SF, "documents")
    rows = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(junk)]
    kept = {r.doc_id for r in cp.language_stage(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
