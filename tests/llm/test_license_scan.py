import re

import math
import random

from landscape.llm.license_scan import NOTICES, PHRASES, Template, scan_licenses

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = [(i, p.label) for p in PHRASES for i in range(len(w))
              if w[i:i + len(p.text.split())] == p.text.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_base_equals_brute_force(spark):
    texts = ["MIT License", "mit-license mit.license MIT  LICENSE", "mitlicense", "the mit İ license", "Kit mit licenſe",
             "GNU General Public License general public general public license", "license mit license apache license",
             "general public\nLicense " * 50, "mit", "", None, "éé mit license", "mit license " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert base(rows[i]) == brute(t), t
    assert rows[12].n_base == 3000 and rows[12].score == 1.0


def test_documents(small):
    docs = {r.doc_id: r.text for r in small("documents").collect()}
    for r in scan_licenses(small("documents")).collect():
        assert base(r) == brute(docs[r.doc_id])


def test_notices_with_changes(spark):
    body = " ".join(f"w{i}" for i in range(30))
    notice = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    words = notice.split()
    texts = {0: f"{body} {notice} {body}", 1: f"{body} {' '.join(words[:8] + ['new'] + words[8:])}",
             2: " ".join(words[:8] + words[9:]), 3: " ".join(words[:5]), 4: " ".join(reversed(words)),
             5: " ".join(words[:8] + body.split() + words[8:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in scan_licenses(df, templates=(Template("greek", notice),)).collect()}
    assert [rows[i].labels for i in range(6)] == ["greek", "greek", "greek", "", "", ""]
    assert rows[0].spans[0].first_word == 30 and rows[0].spans[0].last_word == 45 and rows[0].score == 1.0
    assert all(rows[i].n_base == 0 and rows[i].base_labels == "" for i in texts)


def voted(text, template, drift=2, coverage=0.75):
    """Accepted spans of a notice, vote by vote: (first word, last word, share)."""
    w, t = WORD.findall((text or "").translate(LOWER)), template.text.split()
    votes = sorted((i - j, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i:i + 2] == t[j:j + 2])
    runs, last = [], None
    for d, j in votes:
        if last is None or d - last > drift:
            runs.append([])
        runs[-1].append((d, j))
        last = d
    grams, out = len(t) - 1, []
    for r in runs:
        lo, hi = min(j for _, j in r), max(j for _, j in r)
        first = min(min(d + j for d, j in r if d == e) for e in {d for d, _ in r})
        end = max(d + j for d, j in r)
        share = min(len(r), hi - lo + 1) / grams
        if share >= coverage and end - first < grams + math.ceil(grams * drift / 10):
            out.append((template.label, first, end + 1, round(share, 9)))
    return out


def test_spans_equal_brute_force(spark):
    """Notices whole, cut, with words lost, changed and inserted, twice, and one after the other."""
    rng = random.Random(21)
    texts = []
    for _ in range(60):
        words = []
        for t in rng.choices(NOTICES, k=rng.randint(1, 3)):
            own = t.text.split()
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(own))
                own[i:i + 1] = rng.choice([[], [own[i], "really"], ["other"], [own[i]] * 2])
            words += [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 8))] + own[:rng.choice([len(own), len(own) // 2])]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(df, templates=NOTICES).collect():
        want = sorted(x for t in NOTICES for x in voted(texts[r.doc_id], t))
        assert sorted((s.label, s.first_word, s.last_word, round(s.share, 9)) for s in r.spans) == want
        assert r.labels == ",".join(sorted({x[0] for x in want})) and abs(r.score - max((x[3] for x in want), default=0)) < 1e-9


def test_every_notice_is_found(spark):
    df = spark.createDataFrame([(i, f"Some code. {t.text.title()}.") for i, t in enumerate(NOTICES)], "doc_id long, text string")
    for r in scan_licenses(df).collect():
        assert NOTICES[r.doc_id].label in r.labels.split(",") and r.score == 1.0


def test_edges(edge_docs, no_docs):
    rows = scan_licenses(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    assert all(base(r) == brute(texts[r.doc_id]) and 0 <= r.score <= 1 for r in rows)
    assert scan_licenses(no_docs).count() == 0
