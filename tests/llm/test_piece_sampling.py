import collections
import random

import numpy as np
import public_tokenizers

from landscape.llm.common import mix64
from landscape.llm.piece_sampling import PieceLattice, SamplingParams, decode_pieces, sample_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(m, text):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        for i, b in enumerate(m.bytes_of):
            if i > 258 and b == text[:n].encode():
                yield from ((i, *rest) for rest in segmentations(m, text[n:]))


def test_drawn_as_often_as_weighted():
    m = PieceLattice(PATH, SamplingParams(theta=0.00005))
    n = 60_000
    out, counts = m.sample([" the"], np.zeros(n, np.int64), mix64(np.arange(n, dtype=np.uint64)))
    at = np.concatenate([[0], np.cumsum(counts)])
    seen = collections.Counter(tuple(out[at[i]:at[i + 1]].tolist()) for i in range(n))
    every = list(segmentations(m, " the"))
    weight = np.exp([sum(m.weight[i] for i in s) for s in every])
    weight /= weight.sum()
    assert set(seen) <= set(every)
    for s, w in zip(every, weight):
        assert abs(seen[s] / n - w) < 0.02


def test_lossless_and_independent_of_batches():
    rng = random.Random(2)
    m = PieceLattice(PATH, SamplingParams())
    texts = ["".join(rng.choices(list("ab  \n▁é漢🙂 the\x00<0x0A>"), k=rng.randint(0, 40))) for _ in range(500)]
    texts += [" " * 40, "a" * 3000, "x " * 5000]
    ids = m.encode(texts, np.arange(len(texts), dtype=np.uint64))
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert m.decode(np.concatenate(ids), at) == texts
    for i in range(0, 500, 25):
        assert np.array_equal(m.encode([texts[i]], np.array([i], np.uint64))[0], ids[i])


def test_long_text_in_blocks(monkeypatch):
    import landscape.llm.piece_sampling as ps
    m = PieceLattice(PATH, SamplingParams())
    text = " ".join(f"word{i}  x" for i in range(3000))
    whole = m.encode([text], np.array([5], np.uint64))[0]
    monkeypatch.setattr(ps, "BLOCK", 2048)
    assert np.array_equal(m.encode([text], np.array([5], np.uint64))[0], whole)


def test_round_trip_and_edges(spark, small, edge_docs, no_docs):
    for docs in (small("documents"), edge_docs):
        rows = decode_pieces(sample_pieces(docs, PATH), PATH).collect()
        assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == docs.count()
    twice = [tuple(r.pieces) for r in sample_pieces(edge_docs, PATH).collect() if r.doc_id == 3]
    assert len(twice) == 3 and len(set(twice)) == 1
    assert sample_pieces(no_docs, PATH).count() == 0
