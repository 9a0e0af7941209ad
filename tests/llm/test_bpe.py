from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quillspark.llm.bpe import ByteBpe, encode_table, load_ranks, merge_all

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_ids_equal_the_library(bpe, library, pairs):
    rnd = random.Random(5)
    letters = [*map(chr, range(32, 127)), *"éñßи漢字あ　\u0085\xa0\x1c\n\t 😀  "]
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    for text in [*(t or "" for _, t in pairs), *odd, "a" * 3000, "ab" * 2000, " " * 99 + "x", "\n" * 50]:
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_pieces_equal_the_merges(bpe):
    rnd = random.Random(6)
    for _ in range(500):
        piece = bytes(rnd.choice(b"abcdefthe ") for _ in range(rnd.randint(1, 24)))
        want = [bpe.ranks[piece]] if piece in bpe.ranks else merge_all(piece, bpe.ranks)
        assert bpe.encode_piece(piece) == want


def test_table(docs, none, library):
    for r in encode_table(docs, PATH, P.PATTERN).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["decoded"].decode())
    assert encode_table(none, PATH, P.PATTERN).count() == 0
