from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm.substrings import anchors, repeats, strip_repeats, word_hashes

from .conftest import frame


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("window", "gram", "limit"), [(35, 8, 50_000), (35, 8, 4), (35, 8, 20), (12, 5, 50_000), (12, 5, 2), (6, 6, 50_000), (5, 1, 3)])
def test_equals_brute_force(docs, pairs, window, gram, limit):
    got = strip_repeats(docs, window, gram, limit).collect()
    want = brute([t for _, t in pairs], window)
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(want)
    assert sum(r["n_removed"] for r in got) > 0


def test_carried_columns(docs):
    got = strip_repeats(docs, 35, carry=["source", "text", "h"])
    assert got.columns == ["id", "carry0", "carry1", "carry2", "n_words", "n_removed", "kept"] and got.where("carry2 <> 'x'").count() == 0


def test_small_tables(spark, none):
    assert strip_repeats(none).count() == 0
    assert strip_repeats(frame(spark, [(1, None), (2, "one")])).count() == 2
    whole = " ".join(map(str, range(40)))
    got = strip_repeats(frame(spark, [(1, whole), (1, whole)])).collect()
    assert [r["kept"] for r in got] == ["", ""]


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(0)
    words = [b"w%d" % i for i in rnd.integers(0, 50, 300)]
    passage = [b"p%d" % i for i in range(40)]
    text = words[:100] + passage + words[100:200] + passage + words[200:]
    at, _ = anchors(word_hashes(text), np.full(len(text), len(text)), text, 35, 8)
    places = set(at.tolist())
    for start in range(6):  # windows inside the passage
        mine = {p - 100 for p in places if 100 + start <= p <= 100 + start + 27}
        other = {p - 240 for p in places if 240 + start <= p <= 240 + start + 27}
        assert mine and mine == other or mine & other


def test_words_decide_not_hashes(monkeypatch):
    """With word hashes of two bits almost all windows fall together, and still only equal ones count as repeats."""
    import quillspark.llm.substrings as module

    rnd = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 300, n))
    shared, loud = text(40), text(12)
    texts = [text(60) + " " + shared + " " + text(20) if i % 3 == 0 else text(70) for i in range(12)] + [loud + " " + loud + " " + text(9) + " " + loud]
    weak = lambda words: np.array([1 + len(w) % 4 for w in words], dtype=np.uint64)
    monkeypatch.setattr(module, "word_hashes", weak)
    kept = module.word_numbers(["a", "b", "a"])
    assert kept[0] == kept[2] != kept[1]
    words = [w.encode() for t in texts for w in t.split()]
    owner = np.concatenate([np.full(len(t.split()), i) for i, t in enumerate(texts)])
    later, twice = repeats(module.window_hashes(weak(words), 12), words, 12, owner)
    windows = [(owner[i], tuple(words[i : i + 12])) for i in range(len(words) - 11)]
    count, seen = Counter(windows), set()
    assert twice.tolist() == [count[w] > 1 for w in windows]
    assert later.tolist() == [w in seen or seen.add(w) is not None for w in windows]


def test_long_words_and_texts(spark):
    """A word of a megabyte, words that look like the mark of one, and 200 000 words in one text."""
    rnd = np.random.default_rng(9)
    giant, mark = "x" * 1_000_000, "\x01" + "0" * 64
    shared = " ".join(f"s{i}" for i in range(20)) + f" {giant} {mark} " + " ".join(f"t{i}" for i in range(20))
    long = " ".join(f"w{x}" for x in rnd.integers(0, 2000, 200_000))
    texts = [f"a b {shared}", f"{shared} c", f"{shared[:-4]} other", long + " " + long[-3000:], "la " * 100_000]
    got = strip_repeats(frame(spark, list(enumerate(texts)))).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(brute(texts, 35))
