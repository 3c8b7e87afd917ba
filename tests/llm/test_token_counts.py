import random

import public_tokenizers
from tokenizers import Tokenizer

from landscape.llm.token_counts import RankMerger, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def library(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def test_random_texts_equal_the_library():
    rng = random.Random(1)
    letters = list("aab  \n\t'sStrellvd0½éß漢🙂‍\x00\x1c\x85　!?") + ["<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, "".join(rng.choices("etaoin", k=5000))]
    assert RankMerger(PATH).count(texts).tolist() == [library(t) for t in texts]


def test_every_basic_plane_character():
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!{chr(c)}  {chr(c)}b" for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    assert RankMerger(PATH).count(texts).tolist() == [library(t) for t in texts]


def test_documents(spark, small):
    rows = count_tokens(small("documents"), PATH).collect()
    assert len(rows) == 200
    assert all((r.n_tokens, r.n_bytes) == (library(r.text), len((r.text or "").encode())) for r in rows)


def test_edges(edge_docs, no_docs):
    got = count_tokens(edge_docs, PATH)
    assert set(got.columns) == set(edge_docs.columns) | {"n_bytes"}
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    assert all(r.n_tokens == library(r.text) and r.text_ in ("x", None) for r in rows)
    assert count_tokens(no_docs, PATH).count() == 0
