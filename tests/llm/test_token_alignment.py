import bisect
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from landscape.llm import queries
from landscape.llm.token_alignment import AlignParams, Fragment, Run, align_tokens, compose, fragment, score_links, sides, tree
from landscape.llm.token_counts import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Groups token by token, links by comparing every A with every B token of a group."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    docs, held = {}, collections.Counter()
    for d, t in texts.items():
        docs[d] = None
        if not t:
            continue
        raw = (" " + t).encode()
        e = tok.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(byte_of[c] for c in tok.id_to_token(i))) for i in e.ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
             for i in sp.encode(t)]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            continue
        sides_ = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            sides_.append(out)
        cuts = sorted({e for _, _, e in sides_[0]} & {e for _, _, e in sides_[1]})
        groups, links = [], []
        parts = [collections.defaultdict(list) for _ in sides_]
        for part, side in zip(parts, sides_):
            for x in side:
                part[cuts[bisect.bisect_left(cuts, x[2])]].append(x)
        for c in cuts:
            ga, gb = (part[c] for part in parts)
            groups.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        docs[d] = (len(a), len(b), groups, links)
        held.update(set(links))
    top = collections.defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return {d: (0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], len(x[2]), len(x[3]), sum(held[k] == top[k[0]] for k in x[3]), sum(held[k] for k in x[3]),
             hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for d, x in docs.items()}


def texts_of(n, seed):
    rng = random.Random(seed)
    words = ["the", "Straße", "naïve", "漢字", "🙂", "don't", "x" * 40, "3.14", "  ", "\n", "\t", "tokenization", "unbelievable",
             "<|endoftext|>", "</s>", "▁", "a", " ", "ﬁ", "é", "__init__", "\x00", "!!!"]
    out = {i: "".join(rng.choice(words) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randint(1, 60))) for i in range(n)}
    return out | {1000: None, 1001: "", 1002: " ", 1003: "a", 1004: out[0]}


def result(df, **params):
    p = AlignParams(**params)
    rows = score_links(align_tokens(df, A, B, params=p), p).collect()
    return {r.doc_id: tuple(r[c] for c in RESULT) for r in rows}


@pytest.mark.parametrize("params", [{}, {"chunk": 16, "long_text": 100, "piece": 30, "fan": 2}, {"chunk": 7, "sent": 5}])
def test_equals_brute_force(spark, params):
    texts = texts_of(120, 3)
    texts[2000] = "plain words that are long enough to be cut before words " * 40
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert result(df, **params) == brute(texts)


def test_fragments_compose_in_any_order():
    rng = np.random.default_rng(1)
    digits = sides(A, B).digits
    for _ in range(300):
        n = int(rng.integers(2, 60))

        def ends():
            return np.unique(np.append(rng.choice(n, int(rng.integers(1, n + 1))) + 1, n))

        a_end, b_end = ends(), ends()
        a, b = rng.integers(0, 1000, len(a_end)), rng.integers(0, 1000, len(b_end))
        bounds = np.unique(np.concatenate([[0, n], rng.integers(0, n, 6)]))
        parts = []
        for lo, hi in zip(bounds, bounds[1:]):
            i, j = (a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi)
            if i.any() or j.any():
                parts.append(fragment(Run(a[i], a_end[i], b[j], b_end[j]), digits, not parts))
        whole = fragment(Run(a, a_end, b, b_end), digits, True)
        left = parts[0]
        for x in parts[1:]:
            left = compose(left, x, digits)
        right = parts[-1]
        for x in parts[-2::-1]:
            right = compose(x, right, digits)
        for got in (left, right, tree(parts, digits)):
            assert got.text == whole.text and (got.n_a, got.n_b, got.groups) == (len(a), len(b), whole.groups)
            assert np.array_equal(got.pairs, whole.pairs) and np.array_equal(got.many, whole.many)
            assert not len(got.head.a) and not len(got.tail.a)
    assert compose(Fragment(), whole, digits).text == whole.text


def test_edges(spark, edge_docs, no_docs):
    got = score_links(align_tokens(edge_docs, A, B)).collect()
    want = brute(dict(enumerate([r.text for r in edge_docs.collect()])))
    assert sorted(tuple(r[c] for c in RESULT) for r in got) == sorted(want.values())
    assert score_links(align_tokens(no_docs, A, B)).count() == 0


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in small("documents").collect()}
    got = {r.doc_id: tuple(r[c] for c in RESULT) for r in queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(texts)
