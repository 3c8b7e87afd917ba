import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from landscape.llm.packing import WordIds, fullest, pack_documents, slack_patterns

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, capacity=2048):
    """Every document's pieces in full, sequences gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, ps in by_doc.items():
        ids = ids_of(docs[d])
        want = [(i, i * capacity, ids[i * capacity:(i + 1) * capacity]) for i in range(-(-len(ids) // capacity))]
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in ps) == [
            (i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want]
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *itertools.accumulate(p.length for p in ps)][:-1]
        assert sum(p.length for p in ps) <= capacity
    total = sum(p.length for p in rows)
    return len(by_seq), -(-total // capacity)


def test_ids_equal_the_library():
    rng = random.Random(7)
    letters = list("aabBcZ  \n\n\t\r'ſs.,;:!?Σσéßİ漢🙂‍\x00\x1c\x85 １2<|>%#*$&") + ["<|endoftext|>", "'re", "'LL", "Word.", "ÉTÉ!!"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(4000)]
    coder = WordIds(PATH)
    got = list(coder.ids(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t)[:-1] for t in texts]


def test_fullest_bin_is_the_best():
    rng = random.Random(8)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = {k: items.count(k) for k in items}
        order = sorted(counts, reverse=True)
        used = fullest(counts, order, 40)
        assert all(used[k] <= counts[k] for k in used) and used[order[0]] >= 1
        rest = list(items)
        rest.remove(order[0])
        best = max(order[0] + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n)
                   if order[0] + sum(c) <= 40)
        assert sum(k * u for k, u in used.items()) == best


def test_repeated_patterns_equal_one_by_one():
    rng = random.Random(9)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 200), 60)}
    counts, singles = dict(histogram), []
    while any(counts.values()):
        used = fullest(counts, sorted((k for k in counts if counts[k]), reverse=True), 256)
        singles.append(used)
        for k, u in used.items():
            counts[k] -= u
    repeated = [used for used, times in slack_patterns(histogram, 256) for _ in range(times)]
    assert repeated == singles


def test_documents(small):
    docs = {r.doc_id: r.text for r in small("documents").collect()}
    bins, bound = check(pack_documents(small("documents"), PATH).collect(), docs)
    assert bins <= bound + 1


def test_ids_column(small):
    for r in pack_documents(small("documents").limit(20), PATH, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_edges(edge_docs, no_docs):
    rows = pack_documents(edge_docs, PATH).collect()
    once = edge_docs.dropDuplicates(["doc_id"])
    check(pack_documents(once, PATH).collect(), {r.doc_id: r.text for r in once.collect()})
    assert sum(r.doc_id == 3 for r in rows) == 3
    assert pack_documents(no_docs, PATH).count() == 0
