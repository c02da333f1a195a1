"""Ids against the public tokenizer's own library; merges against the plain rule."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import corpus_encoding as C
from strandline.sources.tables import table

SCHEMA = "doc_id long, text string, k string, t string, ids array<int>"


@pytest.fixture(scope="module")
def encoder():
    return C.BytePairEncoder(C.load_ranks(C.vocabulary_bytes(C.default_vocabulary())), C.default_pattern())


@pytest.fixture(scope="module")
def public(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=C.default_pattern(), mergeable_ranks=encoder.ranks, special_tokens={})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, public, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    want = {r.doc_id: public.encode_ordinary(r.text) if r.text else [] for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: list(r.ids) for r in C.encode_corpus(spark, docs).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)


def test_long_pre_tokens(encoder, public):
    rnd = random.Random(2)
    for n in (2, 3, 31, 32, 33, 1000, 20_000):
        for alphabet in ("a", "ab", "abcdefghij", "аб"):
            word = "".join(rnd.choice(alphabet) for _ in range(n))
            assert encoder.encode(word) == public.encode_ordinary(word)
    assert len(encoder.encode("x" * 300_000)) > 0


def test_tree_against_a_scan():
    rnd = random.Random(4)
    for n in (1, 2, 3, 7, 8, 9, 100):
        ranks = [rnd.choice([C.NONE, *range(5)]) for _ in range(n)]
        tree = C.PairTree(list(ranks))
        for _ in range(60):
            low = min(ranks)
            assert tree.leftmost_least() == ((-1, C.NONE) if low == C.NONE else (ranks.index(low), low))
            at = rnd.randrange(n)
            ranks[at] = rnd.choice([C.NONE, *range(5)])
            tree.set(at, ranks[at])


def test_cases(spark, public):
    texts = [None, "", " ", "\n\n", "two words", "two words", "<|endoftext|>", "é 😀 \u0000", "ab" * 40_000]
    df = spark.createDataFrame([(i if i != 4 else None, t, "clash", "clash", [1]) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(((r.doc_id, list(r.ids)) for r in C.encode_corpus(spark, df).collect()), key=str)
    want = sorted(((i if i != 4 else None, public.encode_ordinary(t) if t else []) for i, t in enumerate(texts)), key=str)
    assert got == want and C.encode_corpus(spark, df).columns == ["doc_id", "ids"]
    assert C.encode_corpus(spark, df.limit(0)).count() == 0
