import collections
import random
import re

from pyspark.sql import functions as F

from landscape.llm.quality_rules import Rule, judge_quality, learn_rules, rule_expression, text_statistics

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_statistics_equal_brute_force(spark, small):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 30))) for _ in range(300)]
    texts += ["".join(rng.choices(list("ab \n\t\x0b\r#|é🙂"), k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["a a a", "a a a a", "a b c a b c", "x\nx\n\nx\n \n ", None, "", "a b c d a b c " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_statistics(df).collect():
        assert counts(r) == brute(texts[r.doc_id]), texts[r.doc_id]
    docs = {r.doc_id: r.text for r in small("documents").collect()}
    for r in text_statistics(small("documents")).collect():
        assert counts(r) == brute(docs[r.doc_id])


def labelled(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randint(0, 99)) for _ in range(80)]
        if bad:
            words = [w + "###" for w in words] if i % 8 == 0 else ["xy"] * 80
        rows.append((i, " ".join(words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_rules_are_learned_and_take_effect(spark):
    df = labelled(spark)
    stats = text_statistics(df, keep=("doc_id", "quality"))
    rules = learn_rules(stats, "quality = 0")
    assert rules and all(r.precision >= 0.9 for r in rules)
    rows = judge_quality(stats, rules).collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.98 * len(rows)
    assert all(not r.kept for r in rows if r.base_failed)
    again = learn_rules(stats.repartition(7), "quality = 0")
    assert again == rules


def test_first_rule_wins_and_no_labels(spark):
    stats = text_statistics(labelled(spark, 8), keep=("doc_id", "quality"))
    rules = [Rule((("words", "<=", 10.0),), 1, 1.0), Rule((("words", ">", 5.0), ("symbol_share", ">", 0.1)), 1, 1.0)]
    got = stats.select("doc_id", rule_expression(rules).alias("r"), F.col("n_symbols")).collect()
    assert {r.r for r in got if r.n_symbols} == {1} and {r.r for r in got if not r.n_symbols} == {None}
    assert learn_rules(stats.limit(0), "quality = 0") == []
    assert learn_rules(stats, "CAST(NULL AS BOOLEAN)") == []
    assert learn_rules(stats, "false") == []


def test_edges(edge_docs, no_docs):
    rows = judge_quality(text_statistics(edge_docs), []).collect()
    assert len(rows) == edge_docs.count()
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    assert all(counts(r) == brute(texts[r.doc_id]) for r in rows)
    assert all(r.base_failed != r.kept for r in rows)
    assert text_statistics(no_docs).count() == 0
