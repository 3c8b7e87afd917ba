import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from landscape.llm import queries
from landscape.llm.common import WHITE, WordHasher, bounded_sample, text_buffer, windows_hash
from landscape.llm.language_id import ConvParams, cut_windows, identify_languages, learn_languages, window_classes
from landscape.llm.toxicity import FtrlParams, ftrl, learn_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    from landscape.llm.common import read
    lang = {r.doc_id: r.lang for r in read(spark, SF, "documents").collect()}
    rows = queries.op9_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark):
    from landscape.llm.common import read
    toxic = {r.doc_id: r.toxic for r in read(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == read(spark, "/root/testdata/sf0.1", "documents").count()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    good = [r.score for r in held if toxic[r.doc_id] == 0]
    bad = np.array([r.score for r in held if toxic[r.doc_id] == 1])
    auc = np.mean([(bad > g).mean() + (bad == g).mean() / 2 for g in good])
    assert auc > 0.95 and sum(g >= 0.5 for g in good) <= 0.01 * len(good) and (bad >= 0.5).mean() > 0.6
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)


def test_language_edges(spark, small, edge_docs, no_docs):
    model = learn_languages(small("documents"), params=ConvParams(epochs=1, least_steps=50))
    got = identify_languages(edge_docs, model)
    rows = got.collect()
    assert set(got.columns) == set(edge_docs.columns) | {"lang_pred"} and len(rows) == edge_docs.count()
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    assert identify_languages(no_docs, model).count() == 0
    assert learn_languages(no_docs) is None
    assert {(r.lang_pred, r.score) for r in identify_languages(edge_docs, None).collect()} == {("und", 0.0)}


def test_windows_cover_the_text():
    text = bytes(range(256)) * 3
    data, offs = np.frombuffer(text, np.uint8), np.array([0, 0, 1, 5, 300, 768])
    row, start, held = cut_windows(data, offs, 96, 3)
    for r in range(5):
        own = row == r
        pairs = {(p, p + 3) for s, h in zip(start[own], held[own]) for p in range(s, s + h - 3)}
        assert pairs == {(p, p + 3) for p in range(offs[r], offs[r + 1] - 3)}
        assert set(range(offs[r], offs[r + 1])) == {p for s, h in zip(start[own], held[own]) for p in range(s, s + h)}
    assert window_classes(data, start, held, 96).shape == (len(row), 96)


def test_pair_tables_equal_a_plain_convolution():
    """Every filter slid over every window, weight by weight."""
    from landscape.llm.language_id import N_CLASSES, ConvModel
    rng = np.random.default_rng(5)
    p = ConvParams(window=24, widths=(2, 3, 5), embed=4, filters=6)
    many = p.filters * len(p.widths)
    m = ConvModel(["a", "b", "c"], rng.normal(size=(N_CLASSES, p.embed)), [rng.normal(size=(k, p.embed, p.filters)) for k in p.widths],
                  rng.normal(size=many), rng.normal(size=(many, 3)), rng.normal(size=3), p)
    x = rng.integers(0, N_CLASSES, (40, p.window))
    got = m.probabilities(x, m.tables())
    for row, prob in zip(x, got):
        pooled = []
        for k, kernel in zip(p.widths, m.kernels):
            for f in range(p.filters):
                pooled.append(max(sum(m.embedding[row[i + j], e] * kernel[j, e, f] for j in range(k) for e in range(p.embed))
                                  for i in range(p.window - k + 1)))
        logit = np.maximum(np.array(pooled) + m.bias, 0) @ m.dense + m.dense_bias
        want = np.exp(logit - logit.max())
        assert np.allclose(prob, want / want.sum(), atol=1e-4)


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        noise = rng.choice(5000, 40, replace=False) + 100
        y = int(i % 5 == 0)
        rows.append((y, np.unique(np.append(noise, rng.integers(0, 5)) if y else noise)))
    m = ftrl(rows, FtrlParams(bits=13))
    assert len(m.index) < 300 and set(range(5)) <= set(m.index.tolist())
    w = m.table()
    assert np.mean([(w[x].sum() + m.intercept >= 0) == y for y, x in rows]) > 0.97


def test_ftrl_equals_a_scalar_loop():
    """Coordinate by coordinate, as the method is published."""
    import math
    rng = np.random.default_rng(4)
    rows = [(int(i % 3 == 0), np.unique(np.append(rng.choice(60, 6), 60 + i % 3))) for i in range(90)]
    p = FtrlParams(bits=7, epochs=3, l1=0.5)
    m = ftrl(rows, p)
    z, n, bias = [0.0] * 128, [0.0] * 128, [0.0, 0.0]

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    def intercept():
        return -bias[0] / ((p.beta + math.sqrt(bias[1])) / p.alpha)

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            y, x = rows[k]
            w, b = {int(i): weight(i) for i in x}, intercept()
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - y
            for i, old in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * old
                n[i] += g * g
            bias[0] += g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / p.alpha * b
            bias[1] += g * g
    assert np.allclose(m.table(), [weight(i) for i in range(128)], atol=1e-5) and abs(m.intercept - intercept()) < 1e-9


def test_labels_of_other_documents_take_no_place(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat(if(id % 4 = 0, 'you are scum ', 'fine text '), id % 7) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS INT) AS toxic")
    foreign = spark.range(20_000).selectExpr("id + 1000000 AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    p = FtrlParams(per_label=100)
    alone, among = learn_toxicity(docs, labels, params=p), learn_toxicity(docs, labels.union(foreign), params=p)
    assert len(among.index) and np.array_equal(alone.index, among.index) and np.array_equal(alone.weight, among.weight)


def test_toxicity_edges(spark, edge_docs, no_docs):
    rows = [(i, "you are scum" if i % 3 == 0 else f"fine text {i % 7}", int(i % 3 == 0)) for i in range(300)]
    rows += [(900, None, 1), (901, "x", None), (902, "y", 7)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = learn_toxicity(labelled.drop("toxic"), labelled.drop("text"))
    got = score_toxicity(edge_docs, model)
    out = got.collect()
    assert set(got.columns) == set(edge_docs.columns) and len(out) == edge_docs.count()
    assert all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    probe = spark.createDataFrame([(1, "you SCUM!"), (2, "fine text 3")], "doc_id long, text string")
    a, b = sorted(score_toxicity(probe, model).collect(), key=lambda r: r.doc_id)
    assert a.score > 0.5 > b.score
    assert score_toxicity(no_docs, model).count() == 0
    none = learn_toxicity(edge_docs, labelled.limit(0))
    assert all(r.score < 0.5 for r in score_toxicity(edge_docs, none).collect())


def test_bounded_sample(spark):
    df = spark.range(5000).selectExpr("id", "id % 10 < 7 AS g", "repeat('x', CAST(id % 50 AS INT)) AS t")
    s = bounded_sample(df, "g", "id", 300, "t", 4000).collect()
    for g in (True, False):
        own = [r for r in s if r.g == g]
        assert 0 < len(own) <= 300 and sum(len(r.t) for r in own) <= 4000
    full = bounded_sample(df, "g", "id", 300, "t", 1 << 20)
    assert {r["count"] for r in full.groupBy("g").count().collect()} == {300}
    assert {r.id for r in full.collect()} == {r.id for r in bounded_sample(df.repartition(9), "g", "id", 300, "t", 1 << 20).collect()}


def test_word_hashes_follow_the_words():
    texts = ["a bb  a", "", "A\tBb\n", "x" * 1000, " ", "a" + "\x0b" + "a"]
    data, offs = text_buffer(pa.array(texts))
    h, at = WordHasher(WHITE)(data, offs)
    words = [w for t in texts for w in t.lower().split()]
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
    sh, so = windows_hash(h, at, 2)
    assert np.diff(so).tolist() == [2, 0, 1, 1, 0, 1] and sh[0] != sh[1] and sh[0] == sh[2]


def test_long_rows_are_cut_at_separators(monkeypatch):
    import landscape.llm.common as common
    text = " ".join(f"word{i}" * (1 + i % 3) for i in range(2000)) + "é" * 700
    data, offs = text_buffer(pa.array(["x y", text, None, "z"]))
    whole = WordHasher()(data, offs)
    monkeypatch.setattr(common, "SLICE_BYTES", 256)
    parts = WordHasher()(data, offs)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_every_language_is_learned(spark):
    """Seventy languages, the rarest with one text: more than the sample holds in full."""
    rows = [(100 * i + j, f"word{chr(97 + i % 26) * 3} text {i} " * 4, f"l{i:02d}") for i in range(70) for j in range(70 - i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn_languages(df, params=ConvParams(epochs=1, least_steps=1, per_language=20))
    assert model.languages == [f"l{i:02d}" for i in range(70)]
    sample = bounded_sample(df, "lang", "doc_id", 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sample} == {f"l{i:02d}": min(18, 70 - i) for i in range(70)}
