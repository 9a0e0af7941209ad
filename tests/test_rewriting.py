from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dialogue, quality_of_search as quality, relational, rewriting, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def grid(rows):
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows])


def test_rewrites(spark):
    q = spark.createDataFrame([(1, "how does the encoder work in nets"), (2, "x" * 60 + " words " + "y" * 60), (3, "这个数据集 of polyps is what"), (4, None)], "query_id long, text string")
    got = {}
    for r in rewriting.rewrites(q).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = r["text"]
    assert got[1] == {0: "how does the encoder work in nets", 1: "encoder work nets approach and evaluation"}
    assert len(got[2]) == 4 and got[3][0].startswith("这个") and set(got[4]) == {0}

    def broken(kind, texts):
        raise RuntimeError

    assert rewriting.rewrites(q.where("query_id = 1"), broken).count() == 1
    assert rewriting.rewrites(q.where("query_id = 1"), lambda kind, texts: []).count() == 1
    assert rewriting.step_back(q.where("query_id = 1")).first()["text"].startswith("background of")
    arxiv = rewriting.for_search_service(rewriting.rewrites(q.where("query_id = 3"), lambda kind, texts: [["polyp data set list"]] * len(texts)))
    assert arxiv.first()["text"] == "polyp data set list"


def test_contextual(spark):
    rows = [(1, 0, "user", "what is U-Net"), (1, 1, "assistant", "a net"), (1, 2, "user", "and its loss"), (2, 0, "user", "alone")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["text"] for r in rewriting.contextual(m, lambda kind, texts: [["loss of U-Net"] if "U-Net" in t else ["?"] for t in texts]).collect()}
    assert got == {(1, 0): "what is U-Net", (1, 2): "loss of U-Net", (2, 0): "alone"}


def test_memory_prompt_and_pointers(spark):
    rows = [(1, 0, "user", "paper: A study of polyps"), (1, 1, "assistant", "ResNet and D-Caps reach 91.5% accuracy, Table 2"), (1, 2, "user", "more on SAMNet and Table 4")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mem = dialogue.memory(dialogue.entities(m))
    r = mem.select("*", dialogue.context_prompt(F.lit("polyps")).alias("prompt")).first()
    assert r["method"][-1] == "SAMNet" and r["table"] == ["Table_2", "Table_4"]
    assert "之前提到的论文: A study of polyps" in r["prompt"] and r["prompt"].endswith("上轮话题: polyps")
    asked = mem.select(*[dialogue.resolved(F.lit(t)).alias(f"a{i}") for i, t in enumerate(["这个方法的损失", "这张表", "该论文", "无关"])]).first()
    assert tuple(asked) == ("SAMNet的损失", "Table_4", "A study of polyps", "无关")


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 5003])
def test_exact_percentile(spark, n):
    import random

    rnd = random.Random(n)
    rows = [(g, rnd.choice([rnd.random(), 0.5, 3.0])) for g in range(3) for _ in range(n)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    got = {r["g"]: r["v"] for r in quality.exact_percentile(df, "v", ["g"]).collect()}
    for g in range(3):
        v = sorted(x for k, x in rows if k == g)
        at = 0.95 * (n - 1)
        want = v[int(at)] + (v[min(int(at) + 1, n - 1)] - v[int(at)]) * (at - int(at))
        assert abs(got[g] - want) < 1e-12
    assert statistics.mean([1]) == 1 and 9 not in got


def test_cross_encoder_plug(spark):
    c = spark.createDataFrame([(1, "q", i, "a" * i + "≤") for i in range(5)], "query_id long, question string, chunk_id long, text string")
    got = quality.cross_encoded(c, lambda q, t: [len(x) / 3 for x in t], 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["rerank_score"]) for r in got] == [(4, 2.0), (3, 1.6667)]


def test_backfill_captions_residue(spark):
    rows = spark.createDataFrame([(1, 0, ""), (2, 1, None), (3, 2, "own")], "chunk_id long, idx long, text string")
    texts = spark.createDataFrame([(1, 9, "by id"), (7, 1, "by place"), (3, 2, "no")], "chunk_id long, idx long, text string")
    assert {r["chunk_id"]: r["text"] for r in relational.backfill(rows, texts).collect()} == {1: "by id", 2: "by place", 3: "own"}
    f = spark.createDataFrame([(1, "a", "50% of Nets", ""), (2, "b", "", "fifty nets"), (3, "a", "500", None)], "id long, paper_source string, caption string, page_text string")
    assert [r["id"] for r in relational.search_captions(f, "NETS").collect()] == [1, 2]
    assert [r["id"] for r in relational.search_captions(f, "50%").collect()] == [1] and [r["id"] for r in relational.search_captions(f, "nets", "b").collect()] == [2]
    hits = spark.createDataFrame([(2,)], "rowid long")
    assert relational.figures_of_hits(hits, f).first()["paper_source"] == "b"
    t = spark.createDataFrame([("x ar Xiv:1 and arXiv: 2",), ("none",)], "text string")
    assert [(r["n_stamps"], r["around"]) for r in relational.residue(t).collect()] == [(2, "x ar Xiv:1 and arXiv: 2")]


def test_keyword_source(spark):
    s = spark.createDataFrame([("samnet_x.pdf", "", "2401.00001", 0), ("other.pdf", "About SamNet", "", 1), ("third.pdf", "", "2507.12345", 2)], "source string, title string, archive_id string, idx long")
    k = spark.createDataFrame([("SamNet",), ("2507.1",), ("About",), ("zz",), ("x",)], "keyword string")
    assert {r["keyword"]: r["source"] for r in relational.keyword_source(k, s).collect()} == {"SamNet": "samnet_x.pdf", "2507.1": "third.pdf", "About": "other.pdf"}


def test_table_blocks(spark):
    g = grid([["Method", "Score", ""], ["", "Dice", ""], ["U-Net", "91", ""]])
    block = one(spark, tables.table_block(g, F.lit("Table_3"), F.lit(2)))
    assert block == "[TABLE_HTML: Table_3 | Page 2]\n<table><tr><th>Method</th><th>Score/Dice</th></tr><tr><td>U-Net</td><td>91</td></tr></table>\n[/TABLE_HTML]"
    assert tuple(one(spark, tables.block_metadata(F.lit(block), F.lit("Table_3")))) == (True, "Table_3", "2")
    assert tuple(one(spark, tables.block_metadata(F.lit("text"), F.lit("Table_1")))) == (False, "Table_1", "")
    data = [["a", "1"], ["b", "2"]]
    assert one(spark, tables.one_header(grid([["a", "1", "2"], ["b", "3", "4"]]))) == [["a", "1", "2"], ["b", "3", "4"]]
    assert one(spark, tables.plausible_table(grid(data))) and not one(spark, tables.plausible_table(grid([["a", "b"]])))
    assert one(spark, tables.split_lines(F.array(F.lit("a\nb"), F.lit("c")))) == [["a", "c"], ["b", ""]]
    page = "text\nTable 2. Results of all\nTABLE III: More words\n"
    assert [one(spark, tables.caption_of(F.lit(page), F.lit(n))) for n in (1, 2, 3)] == ["", "Table 2. Results of all", "TABLE III: More words"]
    c = spark.createDataFrame([(1, 10.0, 5.0, "b"), (1, 10.2, 1.0, "a"), (1, 20.0, 1.0, "c")], "page int, top double, x0 double, text string")
    assert tables.text_of_characters(c).first()["text"] == "ab\nc"
