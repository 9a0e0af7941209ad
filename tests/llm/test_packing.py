from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm.packing import SumOfSquares, WordTokens, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokens():
    return WordTokens(PATH)


def test_ids_equal_the_library(tokens, pairs):
    rnd = random.Random(3)
    odd = ["".join(rnd.choice("aB'sSéΣİ́漢1 \n\t　\x1c!?'llN'T<|>") for _ in range(rnd.randrange(40))) for _ in range(800)]
    for text in [*(t or "" for _, t in pairs), *odd, "<|endoftext|> x", "don't I'M"]:
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens(text.encode()), "<u4").tolist() == want


def test_level_is_the_least_sum_of_squares():
    rnd = random.Random(1)
    packer, window = SumOfSquares(30), 30
    for _ in range(500):
        size = rnd.randint(1, 29)
        counts = packer.count.copy()

        def cost(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < window:
                c[level + size] += 1
            return int((c**2).sum())

        options = [0] + [h for h in range(1, window - size + 1) if counts[h]]
        level = packer.level_for(size)
        assert level in options and cost(level) == min(map(cost, options))
        full = packer.place((0, 0, b"\0" * 4 * size, size), size)
        assert full is None or sum(len(p[2]) for p in full) == 4 * window
    assert int(packer.count.sum()) == len(packer.rest())


@pytest.mark.parametrize("window", [16, 100, 2048])
def test_every_id_lies_in_one_piece(docs, pairs, tokens, window):
    pieces = pack(docs, PATH, window=window).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"]
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    streams = sorted((str(i), tokens((t or "").encode()) + b"\1\0\0\0") for i, t in pairs)
    rebuilt = []
    open_: dict = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (str(p["id"]), p["doc_tokens"], p["start"])):
        open_[p["id"], p["doc_tokens"]].append(p)
    for (i, total), group in open_.items():
        copies = sum(p["length"] for p in group) // total
        assert sum(p["length"] for p in group) == copies * total
        if copies == 1:
            rebuilt.append((str(i), b"".join(p["ids"] for p in group)))
    assert set(rebuilt) <= set(streams) and len(rebuilt) >= 90
    used = sum(p["length"] for p in pieces)
    assert len(by_sequence) * window - used < 3 * window  # three partitions pad one window each at most


def test_empty_table(none):
    assert pack(none, PATH).count() == 0
