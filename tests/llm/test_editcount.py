from __future__ import annotations

import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm.editcount import Counter, PretokenTree, count_edited, edited, header, redactions, trees

PATH = P.path("byte_bpe_multi_50k.tiktoken")
COUNTER = Counter(PATH, P.PATTERN)
LETTERS = "ab 'srelvd1é漢\n\t .,!　"


def check(tree: PretokenTree) -> None:
    pieces = COUNTER.pattern.findall(tree.text)
    assert [n for b, _ in tree.blocks for n in b] == list(map(len, pieces))
    assert tree.total == len(COUNTER.encode(tree.text)) and tree.chars[1] == len(tree.text)


@settings(max_examples=300, deadline=None)
@given(st.text(LETTERS, max_size=60), st.lists(st.tuples(st.integers(0, 70), st.integers(0, 8), st.text(LETTERS, max_size=8)), max_size=6))
def test_edits_equal_a_full_count(text, edits):
    tree = PretokenTree(text, COUNTER)
    check(tree)
    for start, size, new in edits:
        tree.edit(start, start + size, new)
        check(tree)


@settings(max_examples=400, deadline=None)
@given(st.text(LETTERS, max_size=80), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), st.text(LETTERS, max_size=6)), max_size=8))
def test_batches_equal_a_full_count(text, gaps):
    edits, at = [], 0
    for gap, size, new in gaps:
        edits.append((at + gap, at + gap + size, new))
        at += gap + size
    tree = PretokenTree(text, COUNTER)
    tree.edit_all(edits)
    want, last = "", 0
    for start, end, new in edits:
        start, end = min(start, len(text)), min(end, len(text))
        want, last = want + text[last:start] + new, end
    assert tree.text == want + text[last:]
    check(tree)
    again = PretokenTree.kept(tree.text, COUNTER, *tree.flat())
    again.edit_all([(0, 0, "x ")])
    check(again)


def test_many_edits_take_time_in_proportion():
    import time

    text = "mail me@a.org or 12345678 now " * 60_000
    began = time.perf_counter()
    tree = PretokenTree(text, COUNTER)
    tree.edit_all(redactions(text))
    assert tree.total == len(COUNTER.encode(tree.text)) and time.perf_counter() - began < 30


def test_trees_are_kept_between_batches(spark, docs, pairs):
    """A second batch on the table that the first left, both against full counts."""
    first = edited(trees(docs, PATH, P.PATTERN), PATH, P.PATTERN, redactions)
    second = edited(first, PATH, P.PATTERN, header).collect()
    assert len(second) == len(pairs)
    for r in second:
        assert r["n_tokens"] == len(COUNTER.encode(r["text"])) and r["text"].startswith("Document\n")
        assert r["n_before"] == len(COUNTER.encode(r["text"].removeprefix("Document\n"))) and r["n_reencoded"] < 10


def test_query_against_full_counts(spark, tmp_path):
    """Every column of the query, from texts with mail addresses and numbers."""
    from quillspark.llm.queries import op3_edit_counts

    rnd = random.Random(6)
    bits = ["me@a.org", "12345678", "words", "and", "a.b+c@d-e.fr,", "\n\n", "9999999x", "it's"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op3_edit_counts(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        edits = redactions(text)
        masked = text
        for s, e, new in reversed(edits):
            masked = masked[:s] + new + masked[e:]
        n = lambda t: len(COUNTER.encode(t))
        assert (r["n_pretokens"], r["n_tokens"], r["n_edits"], r["n_tokens_after"]) == (len(COUNTER.pattern.findall(text)), n(text), len(edits), n(masked))
        assert (r["n_edits_second"], r["n_tokens_second"], r["n_chars_after"]) == (1, n("Document\n" + masked), len(masked) + 9)


def test_long_documents_reencode_little():
    rnd = random.Random(2)
    tree = PretokenTree(" ".join(rnd.choice(["alpha", "beta", "gamma's", "42"]) for _ in range(20_000)), COUNTER)
    for _ in range(200):
        at = rnd.randrange(len(tree.text))
        assert tree.edit(at, at + rnd.randrange(5), rnd.choice(["", "x", " new words here "])) < 20
    check(tree)


def test_redactions():
    assert redactions("me@a.org 12345678 1234") == [(0, 8, "[mail]"), (9, 17, "[number]")]


def test_table(docs, pairs, none, spark):
    got = count_edited(docs, PATH, P.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(COUNTER.encode(t or "")) for _, t in pairs)
    kind = "array<struct<start:int,end:int,text:string>>"
    df = spark.createDataFrame([(1, "one two", [(0, 3, "three"), (None, None, None), (50, 60, None)]), (2, None, None)], f"doc_id long, text string, e {kind}")
    got = {r["id"]: r for r in count_edited(df, PATH, P.PATTERN, edits_col="e").collect()}
    assert (got[1]["n_edits"], got[1]["n_chars_after"], got[2]["n_edits"], got[2]["n_tokens"]) == (3, 9, 0, 0)
    assert count_edited(none, PATH, P.PATTERN).count() == 0


@pytest.mark.parametrize("edit", [(0, 0, ""), (5, 2, "x"), (-3, 100, "")])
def test_odd_bounds(edit):
    tree = PretokenTree("some text here", COUNTER)
    tree.edit(*edit)
    check(tree)
