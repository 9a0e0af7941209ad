from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillspark.llm.components import components
from quillspark.llm.jaccard import crowded_edges, exact_links, join, keep_one, matrix_forest, pruning_limits, shingle_set, surviving_forest

from .conftest import frame


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(pairs, threshold):
    texts = list(dict.fromkeys(t or "" for _, t in pairs))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if union and len(sets[a] & sets[b]) >= threshold * union - 1e-9 and sets[a] and sets[b]:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = {}
    for i, t in pairs:
        r = find(texts.index(t or ""))
        ids.setdefault(r, []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return sorted(((i, least[find(texts.index(t or ""))], links[texts.index(t or "")], sum((u or "") == (t or "") for _, u in pairs)) for i, t in pairs), key=str)


@pytest.mark.parametrize(("threshold", "block", "crowd"), [(0.8, 1500, 1024), (0.8, 4, 3), (0.6, 7, 5)])
def test_equals_brute_force(docs, pairs, threshold, block, crowd):
    got = join(docs, threshold=threshold, block=block, crowd=crowd)
    have = sorted(((r["id"], r["class_id"], r["n_links"], r["n_copies"]) for r in got.collect()), key=str)
    assert have == brute(pairs, threshold)
    assert max(r[2] for r in have) > 3


def test_keep_one(spark, docs, pairs, none):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    classes = {r["root"] for r in join(docs).collect()}
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len(classes)
    assert {r["doc_id"] for r in got} == {r["class_id"] for r in join(docs).collect()}
    assert keep_one(none).count() == 0 and join(none).count() == 0


def test_pruning_keeps_the_similar():
    limits = pruning_limits(128, 32, 0.8, 1e-6)
    assert [n for n, _ in limits] == [32, 64, 96, 128]
    assert all(least < 0.75 * n for n, least in limits) and limits[-1][1] > 60
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 256, 128, dtype=np.uint8)
    b = a.copy()
    b[::6] += 1  # a sixth of the values differ, all over the signature
    c = rnd.integers(0, 256, 128, dtype=np.uint8)
    assert surviving_forest(np.stack([a, c, b, a]), limits) in ([(0, 2), (0, 3)],)


def test_exact_links_blocks():
    rnd = random.Random(4)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randint(1, 50))], dtype=np.uint64)) for _ in range(40)]
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    i, j = exact_links(sets, None, 0.5)
    assert set(zip(i.tolist(), j.tolist())) == want
    i, j = exact_links(sets[:15], sets[15:], 0.5)
    assert {(a, b + 15) for a, b in zip(i.tolist(), j.tolist())} == {p for p in want if p[0] < 15 <= p[1]}


def test_matrix_forest():
    rnd = np.random.default_rng(2)
    for square in (True, False):
        links = rnd.random((30, 30 if square else 20)) < 0.05
        if square:
            links = (links | links.T) & ~np.eye(30, dtype=bool)
        pairs = {(int(i), int(j) + (0 if square else 30)) for i, j in zip(*np.nonzero(links))}
        found = matrix_forest(links, square)
        assert all((a, b) in pairs or (b, a) in pairs for a, b in found)

        def parts(edges):
            root = list(range(50))
            for _ in range(50):
                for a, b in edges:
                    root[a] = root[b] = min(root[a], root[b])
            return root

        assert parts(found) == parts(pairs) and len(found) == 50 - len(set(parts(pairs)))


def test_crowded_bucket_of_strangers(spark):
    """Members that pruning parts from the head still find each other."""
    rnd = np.random.default_rng(5)
    kinds = rnd.integers(0, 256, (7, 128), dtype=np.uint8)
    rows = [(1, 60, i, kinds[i % 7].tobytes()) for i in range(60)] + [(2, 3, 100 + i, kinds[0].tobytes()) for i in range(3)]
    members = spark.createDataFrame(rows, "bucket long, m long, tid long, sig binary")
    edges = {(r["a"], r["b"]) for r in crowded_edges(members, pruning_limits(128, 32, 0.8, 1e-6), 8).collect()}
    root = {i: i for i in range(110)}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert [root[i] for i in range(60)] == [i % 7 for i in range(60)] and [root[100 + i] for i in range(3)] == [100] * 3


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a b", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a a", 1)])
def test_shingles(text, n):
    assert len(shingle_set(text.encode(), 5)) == n


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row(spark):
    r = join(frame(spark, [(None, None)])).first()
    assert (r["class_id"], r["n_links"], r["n_copies"]) == (None, 0, 1)
