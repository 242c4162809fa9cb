import os
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from prumo.llm.bpe import PATTERN, VOCABULARY, Encoder, Vocabulary, encode_corpus, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    tokens = read_ranks()
    return Encoder(Vocabulary(tokens)), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_every_token_has_its_halves(both):
    v = both[0].v
    assert all(v.tokens[v.left[i]] + v.tokens[v.right[i]] == t for i, t in enumerate(v.tokens) if len(t) > 1)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_library_encodes_it(both, s):
    assert both[0].encode(s) == both[1].encode_ordinary(s)


def test_joined_tokens_and_long_pieces(both):
    ours, theirs = both
    rng = random.Random(7)
    for _ in range(1500):
        s = "".join(rng.choice(ours.v.tokens).decode("utf-8", "ignore") for _ in range(rng.randint(1, 6)))
        assert ours.encode(s) == theirs.encode_ordinary(s)
    for s in ("a" * 50_000, " " * 5000, "ab" * 20_000, "é" * 3000, "<|endoftext|>", "​﻿"):
        assert ours.encode(s) == theirs.encode_ordinary(s)


def test_corpus(spark, both):
    df = spark.createDataFrame([(1, "Casa à venda", "x"), (2, None, "x"), (3, "", "x"), (4, " ", None), (1, "Casa à venda", "x"), (None, "a", "x"), (5, "casa " * 30_000, "x")], "doc_id bigint, text string, ids string")
    got = encode_corpus(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    for r in got.collect():
        assert r.ids == {1: both[1].encode_ordinary("Casa à venda"), 2: [], 3: [], 4: both[1].encode_ordinary(" "), None: both[1].encode_ordinary("a"), 5: both[1].encode_ordinary("casa " * 30_000)}[r.doc_id]
    n = len(both[1].encode_ordinary("Casa à venda"))
    assert rows(encode_corpus(df.where("doc_id < 4"), counts_only=True)) == [(1, n), (1, n), (2, 0), (3, 0)]
    assert encode_corpus(df, counts_only=True).count() == 7
    assert encode_corpus(df.limit(0)).count() == 0
