import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evolvent.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(PATH)


@pytest.fixture(scope="module")
def judge():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


HARD = [
    "a", " ", "\n\n \t x", "it's WE'LL can't", "<|endoftext|>", "a" * 255, "b" * 256, "c" * 257, "ab" * 3000, " " * 4000, "é" * 700, "日本語のテキスト",
    "x​z­﻿", "\x00\x01\x1c\x1d", "👩‍👩‍👧‍👦" * 40, "1234567890" * 60, "՘a՘1", "مرحبا بالعالم", "ạ́", "!!!???...###" * 50, "　  x",
]


def test_hard_texts(enc, judge):
    assert enc.encode(HARD) == [judge(t) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(enc, judge, text):
    assert enc.encode([text])[0] == (judge(text) if text else [])


def test_matrix_and_heap_agree(enc):
    r = random.Random(2)
    for _ in range(60):
        w = bytes(r.choice(b"abcdeinorst \xc3\xa9") for _ in range(r.randrange(1, 120)))
        assert enc.vocabulary._matrix([w, b"zz"])[0] == enc.vocabulary._heap(w)


def test_corpus(spark, judge):
    data = [(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, " ", "x"), (5, "word " * 50_000, "x")]
    df = bpe.encode_corpus(spark.createDataFrame(data, "doc_id bigint, text string, ids string"), "doc_id", "text", PATH)
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in df.collect()))
    assert got == sorted(((i or 0, judge(t) if t else []) for i, t, _ in data))
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", PATH).collect() == []
