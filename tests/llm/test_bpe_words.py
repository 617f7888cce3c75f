"""Cutting a text at blanks before encoding must not move a pre-token, whatever white space stands around."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from meterloom.llm import byte_bpe

#: Every kind of white space, what only looks like it, and letters, digits and marks of one to four bytes.
SIGNS = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x7f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​",
         "a", "B", "é", "ß", "日", "🎉", "½", "1", "23", "'s", "'", ".", "…", "the", "́", "﻿"]


@pytest.fixture(scope="module")
def made():
    return byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_words_cover_texts_and_keep_pre_tokens(made):
    draw = random.Random(11)
    texts = ["", " ", "  ", "a ", " a", "", "a  ", " b"] + ["".join(draw.choices(SIGNS, k=draw.randint(0, 14))) for _ in range(20_000)]
    words, first = byte_bpe._words(pa.array(texts))
    words = words.to_pylist()
    for text, lo, hi in zip(texts, first, first[1:]):
        own = words[lo:hi]
        assert "".join(own) == text
        assert [p for w in own for p in made.any_text.findall(w)] == made.any_text.findall(text), repr(text)


def test_documents_match_library(made, monkeypatch):
    """Also while the worker's memory turns over, and for a column that starts inside its buffers."""
    monkeypatch.setattr(byte_bpe, "MEMO", 50)
    draw = random.Random(12)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made.ranks, special_tokens={})
    texts = ["".join(draw.choices(SIGNS, k=draw.randint(0, 60))) for _ in range(500)]
    column = pa.array(["skipped", *texts]).slice(1)
    got = [(t, d, n) for _ in range(2) for ids, raw, count in byte_bpe._documents(made, column) for t, d, n in zip(ids.to_pylist(), raw.to_pylist(), count.tolist())]
    want = [(" ".join(map(str, ids)).encode(), t.encode(), len(ids)) for t in texts for ids in [library.encode_ordinary(t)]]
    assert got == want * 2


def test_merges_in_rows_match_single_heaps(made):
    draw = random.Random(13)
    alphabet = [b"a", b"b", b"e", b"t", b"h", b" ", b"in", b"the", b"tion", b"\xc3\xa9", b"\xff", b"0"]
    pieces = [b"".join(draw.choices(alphabet, k=draw.randint(1, 40)))[: draw.randint(1, 90)] for _ in range(4000)] + [b"a" * n for n in range(1, 100)]
    assert made.merge_all(pieces) == [made.merge(p) for p in pieces]
    assert made.merge_all([]) == []
