"""Source records: JSON layouts, parties, entities, yearly parts."""

import json

import pytest

from landscape.operators import ingest as IG
from landscape.session import ensure_checkpoint_dir

WORKS = [{"id": f"W{i}", "doi": f"10.1/{i}", "display_name": f"Title {i}", "publication_year": 2000 + i,
          "concepts": [{"id": f"C{j}", "display_name": f"c{j}", "level": "0", "score": "0.5"} for j in range(20)],
          "authorships": [{"author": {"id": f"A{j}"}, "institutions": [{"id": "I1", "homepage_url": "http://i1"}, {"id": "I2"}]} for j in range(13)],
          "mesh": [{"descriptor_ui": "D1", "descriptor_name": "Humans", "qualifier_name": None}],
          "referenced_works": ["W7", "W8"], "abstract_inverted_index": {"b": [1], "a": [0, 2]}} for i in range(2)]


def test_arrays_over_several_lines_and_json_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps(WORKS, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, WORKS)))
    for name, multi in (("array", True), ("lines", False)):
        raw = IG.read_works_json(spark, str(tmp_path / f"{name}.json"), multi_line=multi)
        assert sorted(r.id for r in raw.collect()) == ["W0", "W1"]
        one = raw.where("id = 'W0'")
        assert (IG.work_metadata(one).count(), len(IG.work_metadata(one).columns)) == (1, 10)
        assert IG.work_concepts(one).count() == 20 and IG.work_authorships(one).count() == 26
        assert sorted(r.cited for r in IG.work_citations(one).collect()) == ["W7", "W8"]
        assert {(r.id, r.homepage_url) for r in IG.institution_metadata(one).collect()} == {("I1", "http://i1"), ("I2", None)}
        assert [(r.doc_id, r.descriptor_name) for r in IG.work_mesh(one).collect()] == [("W0", "Humans")]
        assert IG.deinvert_abstract(one).first().abstract == "a b a"


def test_corrupt_records_fail(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": "W1"}, {"id": ')
    with pytest.raises(Exception):
        IG.read_works_json(spark, str(tmp_path / "bad.json")).collect()


def test_party_types(spark):
    rows = [("P1", [("JOHN DOE", "GB"), ("MARY JANE", "US"), ("JACK VINES", "GB")], [("JACK VINES", "GB"), ("UNIV WASHINGTON", "US")])]
    raw = spark.createDataFrame(rows, "publication_number string, inventor_harmonized array<struct<name:string,country_code:string>>, "
                                      "assignee_harmonized array<struct<name:string,country_code:string>>")
    p = IG.unnest_parties(raw)
    r = p.first()
    assert r.inventor_harmonized_names == ["JOHN DOE", "MARY JANE", "JACK VINES"]
    assert r.assignee_harmonized_country_codes == ["GB", "US"]
    assert IG.assignee_types(p).first().assignee_types == ["PERSON", "ORGANISATION"]
    assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_entities_above_the_threshold(spark):
    rows = [("d1", [("http://x/y/Machine_learning", 90), ("http://x/Low", 60)]), ("d2", []), ("d3", [("http://x/Low", 10)])]
    df = spark.createDataFrame(rows, "doc_id string, annotations array<struct<URI:string,confidence:int>>")
    got = {r.doc_id: r.entities for r in IG.reformat_entities(df).collect()}
    assert got == {"d1": ["Machine learning"], "d2": [], "d3": []}


def test_forward_citation_pages(spark):
    pages = [{"meta": {"count": 2, "page": p}, "results": [{"id": f"W{i}", "referenced_works": [f"R{p}"]} for i in (1, 2)]} for p in (1, 2)]
    df = spark.createDataFrame([(json.dumps(p),) for p in pages], "json string")
    assert sorted((r.citing, r.cited) for r in IG.parse_forward_citations(df).collect()) == [("W1", "R2"), ("W2", "R2")]


def test_hot_year_is_written_whole(spark, tmp_path):
    rows = [(i, 2000 if i % 3 else 2000 + i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, year int")
    IG.write_by_year(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.year) for r in back.collect()) == sorted(rows)
    last = IG.concat_yearly_parts(df.withColumnRenamed("k", "id").selectExpr("id % 10 AS id", "year"), "id")
    assert {(r.id, r.year) for r in last.collect()} == {(k, max(y for i, y in rows if i % 10 == k)) for k in range(10)}


def test_cluster_without_a_shared_folder_fails():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_arrays_are_bounded(spark, tmp_path, monkeypatch):
    """A year of many records is several files, each one array; all records come back."""
    import glob
    import json

    from landscape.sources import nested
    monkeypatch.setattr(nested, "ARRAY_RECORDS", 40)
    df = spark.range(500).selectExpr("concat('w', id) AS id", "if(id % 7 = 0, null, cast(2000 + id % 2 AS int)) AS publication_year",
                                     "concat('a{\"', id) AS display_name").repartition(2)
    nested.write_json_arrays(df, f"{tmp_path}/arrays", "publication_year")
    sizes = [len(json.load(open(f))) for f in glob.glob(f"{tmp_path}/arrays/*/*.txt")]
    assert sum(sizes) == 500 and max(sizes) <= 40
    back = IG.read_works_json(spark, f"{tmp_path}/arrays").select(*df.columns)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


@pytest.mark.parametrize("repeats", [False, True])
def test_texts_are_inverted_where_they_are_read(spark, monkeypatch, repeats):
    """Empty and missing texts, empty words, ids that repeat and no id: words are only moved for the last two."""
    from collections import defaultdict
    monkeypatch.setattr(IG, "INVERTED_BYTES", 30)
    rows = [(i, t) for i, t in enumerate(["a b a", "", None, " a  b ", "é漢🙂 a", "x " * 50, "\n\t a"] * 3)]
    if repeats:
        rows += [(0, "b a"), (None, "n a"), (None, "n"), (2, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    inv = IG.invert_abstract(df)
    plan = inv._jdf.queryExecution().optimizedPlan().toString()
    assert repeats or not any(x in plan for x in ("Aggregate", "Join"))
    want = defaultdict(lambda: defaultdict(list))
    for i, t in rows:
        for pos, word in enumerate(t.split(" ") if t is not None else []):
            want[i][word].append(pos)
    got = {r.doc_id: r.abstract_inverted_index for r in inv.collect()}
    assert got == {i: {w: sorted(p) for w, p in at.items()} for i, at in want.items()} and inv.count() == len(want)
