from __future__ import annotations

import pytest

from quillspark.operators import search
from quillspark.plans import retrieval

CHUNK = "chunk_id long, idx long, source string, title string, archive_id string, section_id string, section_title string, table_id string, is_table boolean, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (0, 0, "samnet.pdf", "About nets", "2507.10001", "2.3", "Method", "", False, "the encoder has blocks"),
        (1, 1, "samnet.pdf", "About nets", "2507.10001", "2.31", "Dataset", "", False, "images of polyps"),
        (2, 2, "samnet.pdf", "About nets", "2507.10001", "2.31", "Dataset", "", False, "more polyps and images"),
        (3, 3, "samnet.pdf", "About nets", "2507.10001", "2.31", "Dataset", "", False, "   "),
        (4, 4, "samnet.pdf", "About nets", "2507.10001", "", "", "Table_2", True, "dice of nets"),
        (5, 5, "trees.pdf", "Trees", "2401.00002", "2.3", "Method", "Table_2.", True, "dice of trees"),
        (6, 6, "trees.pdf", "Trees", "2401.00002", "4", "Results", "", False, "trees grow slowly"),
        (7, 7, "sky.pdf", "Sky", "", "1", "Intro", "", False, "clouds and rain"),
        (8, 8, "sky.pdf", "Sky", "", "1", "Intro", "", False, "clouds and rain"),
    ]
    chunks = spark.createDataFrame(rows, CHUNK)
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(9)]) for i in range(9)], "chunk_id long, embedding array<float>")
    return search.bm25_index(chunks).stored(), vectors


def found(spark, corpus, questions, **how):
    index, vectors = corpus
    asked = spark.createDataFrame(questions, "query_id long, text string")
    given = spark.createDataFrame([(q, [0.1 * (i + 1) for i in range(9)]) for q, _ in questions if q != 99], "query_id long, embedding array<float>")
    out: dict = {}
    for r in retrieval.retrieve(index, vectors, asked, given, **how).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["tier"]))
    return {q: [(c, t) for _, c, t in sorted(x)] for q, x in out.items()}


def test_tiers(spark, corpus):
    got = found(spark, corpus, [(1, "show Table 2 of the SamNet paper"), (2, "Table 2 please"), (3, "Table 7 please"), (4, "Section 2.3 of the SamNet paper"), (5, "Section 4 there"), (6, "the SamNet paper in Section 9"), (7, "clouds"), (8, None)])
    assert got[1] == [(4, 0)] and got[2][0][1] == 0 and len(got[2]) == 1 and 3 not in got
    # 2.3 is a prefix of 2.31; the blank chunk never counts.
    assert {c for c, _ in got[4]} == {0, 1, 2} and {t for _, t in got[4]} == {2}
    assert got[5] == [(6, 4)] and {c for c, _ in got[6]} == {0, 1, 2, 4} and {t for _, t in got[6]} == {3}
    assert {t for _, t in got[7]} == {5} and [c for c, _ in got[7]].count(7) + [c for c, _ in got[7]].count(8) == 1  # one of equal texts


def test_sections_are_bundled_for_lists(spark, corpus):
    index, vectors = corpus
    questions = [(1, "Section 2.31 datasets of the SamNet paper")]
    got = found(spark, corpus, questions)
    assert {c for c, _ in got[1]} == {1, 2}


def test_ranker_and_rewrites(spark, corpus):
    rewrites = spark.createDataFrame([(1, 1, "trees grow slowly here"), (1, 2, "TREES GROW SLOWLY HERE"), (1, 3, "short one")], "query_id long, pos int, text string")
    got = found(spark, corpus, [(1, "rain of some kind")], rewrites=rewrites, ranker=lambda q, texts: list(range(len(texts)))[::-1], k=3)
    plain = found(spark, corpus, [(1, "rain of some kind")], rewrites=rewrites, k=9)
    assert got[1] == plain[1][::-1][:3] and 6 in {c for c, _ in plain[1]}
    broken = found(spark, corpus, [(1, "rain of some kind")], rewrites=rewrites, ranker=lambda q, texts: [0, 0], k=9)
    assert broken[1] == plain[1]


def test_nothing_asked(spark, corpus):
    index, vectors = corpus
    none = spark.createDataFrame([], "query_id long, text string")
    assert retrieval.retrieve(index, vectors, none, spark.createDataFrame([], "query_id long, embedding array<float>")).count() == 0
