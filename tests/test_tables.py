from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import search, tables
from quillspark.plans.assistant import Assistant, tools

GRID = [["Method", "Dice", ""], ["U-Net", "91.5", ""], ["Two\nLines", "8|9", ""]]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(grid):
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in grid])


def test_grid(spark):
    assert one(spark, tables.grid_score(lit(GRID))) == 3 * 3 * 2 + 6 + 80 + 3 - 5
    assert one(spark, tables.grid_html(lit(GRID), F.lit("T"))) == "<table><caption>T</caption><tr><th>Method</th><th>Dice</th></tr><tr><td>U-Net</td><td>91.5</td></tr><tr><td>Two Lines</td><td>8|9</td></tr></table>"
    assert one(spark, tables.grid_markdown(lit(GRID))) == "| Method | Dice |\n| --- | --- |\n| U-Net | 91.5 |\n| Two Lines | 8\\|9 |"
    html = tables.grid_html(lit(GRID), F.lit("Table 1"))
    assert one(spark, tables.table_text(html)) == "Table 1 | Columns: Method, Dice | Rows: U-Net, 91.5; Two Lines, 8|9 | Keys: U-Net, Two Lines"


def test_boxes(spark):
    rows = [(1, 1, 5.0, (0.0, 0.0, 10.0, 10.0)), (1, 2, 4.0, (0.0, 0.0, 10.0, 9.0)), (1, 3, 3.0, (50.0, 0.0, 60.0, 10.0))]
    df = spark.createDataFrame(rows, "page long, id long, score double, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted(r["id"] for r in tables.best_boxes(df, ["page"]).collect()) == [1, 3]


def test_document_parts(spark):
    text = "Title\nAbstract: We do it.\n1. Introduction\nbody\nReferences\n[1] A. Author, a long enough title. [2] short [3] B. Other,\n another long enough title."
    assert one(spark, tables.abstract_of(F.lit(text))) == "We do it."
    assert one(spark, tables.reference_items(F.lit(text))) == ["A. Author, a long enough title.", "B. Other, another long enough title."]


@pytest.fixture(scope="module")
def assistant(spark):
    chunks = spark.createDataFrame([(0, "deep nets segment polyps"), (1, "a benchmark of datasets"), (2, "trees"), (3, "sea"), (4, "sky")], "chunk_id long, text string")
    return Assistant(search.bm25_index(chunks))


def test_assistant(spark, assistant):
    assert "deep nets" in assistant.ask("nets for polyps")
    assert [s for s, _ in assistant.steps] == ["retrieve", "generate"] and all(x == "done" for _, x in assistant.steps)
    broken = Assistant(assistant.index, generate=lambda q, c: 1 / 0)
    assert broken.ask("nets") == "" and broken.steps[-1][1].startswith("failed")


def test_tools(spark, assistant):
    papers = spark.createDataFrame([("1", "Deep nets", "x", ["a"] * 5, ["c"], "2024-01-01", "2024-01-01")], "archive_id string, title string, abstract string, authors array<string>, categories array<string>, published string, updated string")
    registry = tools(assistant, papers)
    assert json.loads(registry["search_papers"]("nets"))[0]["authors"] == ["a"] * 3
    assert json.loads(registry["get_paper_info"]("9")) is None
    assert json.loads(registry["rag_query"]("trees"))[0]["chunk_id"] == 2
    assert "error" in json.loads(registry["search_papers"]("nets", sort="no"))


def test_assistant_falls_back_and_reports(spark):
    from quillspark.plans.assistant import PLUGS, plug, register

    chunks = spark.createDataFrame([(1, "nets find polyps", "a.pdf", "Method", "Table_2"), (2, "trees grow", "b.pdf", "", ""), (3, "sky", "c.pdf", "", ""), (4, "sea", "c.pdf", "", "")], "chunk_id long, text string, source string, section_title string, table_id string")
    papers = spark.createDataFrame([("2401.1", "Deep seas", "About whales and seas.", ["A"], ["q"], None, None, None)], "archive_id string, title string, abstract string, authors array<string>, categories array<string>, published string, updated string, pdf_url string")
    a = Assistant(search.bm25_index(chunks), papers=papers, rewrite=plug("rewriter", "templates"))
    assert a.ask("polyps").startswith("[1] a.pdf, Method table Table_2\nnets find polyps")
    assert "whales" in a.ask("whales swim") and [s for s, _ in a.steps] == ["retrieve", "generate", "retrieve", "abstracts", "generate"]
    assert a.report().count() == 5
    told = a.quick("trees", [("user", "earlier")] * 12)
    assert told.startswith("[1] b.pdf") and told.count("user: earlier") == 10
    register("reranker", "first", lambda q, t: list(range(len(t))))
    assert plug("reranker", "first")("q", ["a", "b"]) == [0, 1]
    with pytest.raises(ValueError):
        plug("parser", "none")
    del PLUGS["reranker"]["first"]
    a.generate = lambda q, c: 1 / 0
    assert a.ask("polyps") == "" and a.steps[-1][1].startswith("failed")
