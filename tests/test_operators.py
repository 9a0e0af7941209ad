"""Operators on small tables with expectations worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.operators import chunking, dialogue, quality_of_search, relational, routing, search


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("text", "want"), [("Deep  Nets\tRule", ["deep", "nets", "rule"]), ("模型 net", ["模", "型", "net"]), ("", []), (None, [])])
def test_tokenize(spark, text, want):
    assert one(spark, tx.tokenize(lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "want"), [("你好", True), ("attention 机制", True), ("attention", False), (None, False)])
def test_has_cjk(spark, text, want):
    assert one(spark, tx.has_cjk(lit(text).cast("string"))) is want


def test_token_estimate(spark):
    assert one(spark, tx.token_estimate(lit("abcdefgh"))) == 2
    assert one(spark, tx.token_estimate(lit("数据集"))) == 2


def test_date_clause(spark):
    d = lambda s: lit(s).cast("date")
    assert one(spark, tx.date_clause(d("2024-01-15"), d("2024-06-30"), lit("submitted"))) == "submittedDate:[202401150000 TO 202406302359]"
    assert one(spark, tx.date_clause(d(None), d("2023-12-31"), lit("updated"))) == "lastUpdatedDate:[* TO 202312312359]"
    assert one(spark, tx.date_clause(d(None), d(None), lit("submitted"))) == ""


@pytest.mark.parametrize(("stamp", "want"), [("2024-05-10T12:00:00+00:00", True), ("2023-01-01", False), (None, True), ("soon", True)])
def test_date_range(spark, stamp, want):
    assert one(spark, tx.in_date_range(lit(stamp).cast("string"), "2024-01-01", "2024-12-31")) is want


@pytest.mark.parametrize(("title", "want"), [("Deep Nets: A Study", "Deep_Nets_A_Study"), ("", "paper"), (None, "paper"), ("ＡＢ／Ｃ", "ABC"), ("A" * 200, "A" * 120)])
def test_file_stem(spark, title, want):
    assert one(spark, tx.file_stem(lit(title).cast("string"))) == want


@pytest.mark.parametrize(("name", "want"), [("2401.00001", True), ("2401.00001v3", True), ("paper", False), (None, False)])
def test_archive_id(spark, name, want):
    assert one(spark, tx.is_archive_id(lit(name).cast("string"))) is want


@pytest.mark.parametrize(("text", "want"), [
    ("net(fast) see https://a.b/C(d) end.Start LoRA2x", "net (fast) see https://a.b/C(d) end. Start Lo RA 2x"),
    ("ar Xiv:1912.11947v 1  [eess. IV]  26 Dec 2019 textgithub.com/A/Bc1", " text github.com/A/Bc1"),
    ("segmentanything Segmentanything Asegmentanything", "segment anything Segment anything A segment anything"),
    ("oneandmedicalimages", "oneand medical images"),
    ("", ""), (None, ""),
])
def test_unglue(spark, text, want):
    assert one(spark, tx.unglue(F.lit(text).cast("string"))) == want


def test_embed_text_and_json(spark):
    assert one(spark, tx.embed_text(lit("P"), lit("S"), lit("One. Two."), lit("a\x00b\ufffd"))) == "[P] | Section: S | Prev: One | a b "
    assert one(spark, tx.embed_text(lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"), lit("t"))) == "t"
    assert one(spark, tx.salvaged_json(lit('so: {"a": 1} done'), "a int"))["a"] == 1 and one(spark, tx.salvaged_json(lit("none"), "a int")) is None
    assert one(spark, tx.integer_list(lit("order [3, 1,2] ok"))) == [3, 1, 2] and one(spark, tx.integer_list(lit("no"))) == []
    pair = lambda *x: F.create_map(*map(F.lit, x))
    assert one(spark, tx.with_defaults(pair("a", "1"), pair("a", "0", "b", "2"))) == {"a": "1", "b": "2"}
    assert one(spark, tx.with_defaults(F.lit(None).cast("map<string,string>"), pair("b", "2"))) == {"b": "2"}


def test_links(spark):
    assert one(spark, tx.links(lit("""<a href="x y"> <a HREF='z'> <a href = q>"""))) == ["x y", "z", "q"]
    assert [one(spark, tx.link_label(lit(x))) for x in ("https://GitHub.com/a", "http://b")] == ["code", "link"]
    assert one(spark, tx.plain_symbols(lit("α≤β → ∞"))) == "alpha<=beta -> inf"


def test_vectors(spark):
    a = lit([3.0, 4.0])
    assert one(spark, vx.norm(a)) == 5.0
    assert one(spark, vx.normalized(lit([0.0, 0.0]))) == [0.0, 0.0]
    v = one(spark, vx.hashed_embedding(F.array(lit("a"), lit("b"))))
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_bm25_matches_formula(spark):
    import math

    docs = ["a b a", "b c", "c d e", "f g"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "chunk_id long, text string")
    queries = spark.createDataFrame([(0, "a c"), (1, "zzz")], "query_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in search.bm25_search(search.bm25_index(chunks), queries, 10).collect()}
    split = [d.split() for d in docs]
    n, avg = 4, sum(map(len, split)) / 4
    df = {t: sum(t in d for d in split) for d in split for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    least = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: least if v < 0 else v for t, v in idf.items()}
    want = {}
    for i, d in enumerate(split):
        s = sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ("a", "c"))
        if round(s, 6):
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_bm25_filter_keeps_statistics(spark):
    chunks = spark.createDataFrame([(0, "a b", "x"), (1, "a c", "y"), (2, "d e", "y"), (3, "f", "y"), (4, "g", "y")], "chunk_id long, text string, source string")
    queries = spark.createDataFrame([(0, "a b")], "query_id long, text string")
    index = search.bm25_index(chunks)
    every = {r["chunk_id"]: r["score"] for r in search.bm25_search(index, queries).collect()}
    some = {r["chunk_id"]: r["score"] for r in search.bm25_search(index, queries, where=F.col("source") == "y").collect()}
    assert some == {1: every[1]}
    zero = search.bm25_search(index, queries, 4, keep_zero=True).collect()
    assert [r["chunk_id"] for r in sorted(zero, key=lambda r: r["rank"])] == [0, 1, 2, 3]


def test_bm25_in_the_scan_equals_the_join(spark):
    """Many ties, repeated and unknown words, more chunks than k in each task."""
    import random

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(600)], "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame([(i, " ".join(rnd.choice([*words, "zz"]) for _ in range(rnd.randint(0, 5)))) for i in range(300)] + [(None, "w1")], "query_id long, text string")
    index = search.bm25_index(chunks)
    where = F.col("chunk_id") % 3 > 0
    for k, only in ((5, None), (700, where)):
        want = search.top_k(search.bm25_scores(index, queries.where("query_id is not null"), only).where("round(score, 6) <> 0"), k)
        key = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())
        assert key(search.bm25_search(index, queries, k, only)) == key(want)
    assert search.bm25_best(index, queries, 5, most_pairs=3) is None


def test_router_substrings(spark):
    """Trigrams find just the names that hold a token."""
    import itertools

    from quillspark.operators.routing import inside

    stems = ["segment anything", "sam_2 model", "a b c", "net", "polyp segnet v2", ""]
    tokens = ["seg", "segment", "anything", "egn", "tan", "abc", "et v", "v2x", "model", "sam_2", "nett"]
    s = spark.createDataFrame([(f"{i}.pdf", x, x.replace(" ", "")) for i, x in enumerate(stems)], "source string, stem string, compact string")
    w = spark.createDataFrame([(t, 1.0) for t in tokens], "token string, idf double")
    want = {(t, f"{i}.pdf") for t, (i, x) in itertools.product(tokens, enumerate(stems)) if t in x or t in x.replace(" ", "")}
    assert {(r["token"], r["source"]) for r in inside(w, s, ["stem", "compact"]).collect()} == want and len(want) > 8


def test_vector_search_blocks_agree(spark):
    data = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(20)]
    corpus = spark.createDataFrame(data, "chunk_id long, embedding array<float>")
    queries = corpus.select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = rows(search.vector_search(corpus, queries, 3))
    assert whole == rows(search.vector_search(corpus.repartition(3), queries, 3, block=4, most_held=5))
    best = {}
    for q, a in data:
        order = sorted(data, key=lambda x: (-round(sum(u * v for u, v in zip(a, x[1])), 6), x[0]))
        best[q] = [i for i, _ in order[:3]]
    got = {}
    for q, c, _, r in whole:
        got.setdefault(q, {})[r] = c
    assert {q: [x[1], x[2], x[3]] for q, x in got.items()} == best
    assert search.vector_search(corpus, queries.limit(0), 3).count() == 0


def test_fusion(spark):
    c = spark.createDataFrame([(0, 1, 0.9, 2.0), (0, 2, 0.1, 4.0), (1, 1, 0.5, 0.0), (1, 2, 0.5, 0.0)], "query_id long, chunk_id long, vector_score double, bm25_score double")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.minmax_fuse(c).collect()}
    assert got == {(0, 1): 0.6, (0, 2): 0.4, (1, 1): 1.0, (1, 2): 1.0}


@pytest.mark.parametrize(("text", "want"), [("which Encoder and data", "architecture"), ("metadata of it", "dataset"), ("ablation", "experiment"), ("hyperparameter", "config"), ("why", "general"), ("这个数据集", "dataset")])
def test_intent(spark, text, want):
    assert one(spark, routing.intent(lit(text))) == want


def test_section_boost(spark):
    b = lambda q, i, t: one(spark, routing.section_boost(lit(q), lit(i), lit(t)))
    assert b("x", "dataset", "Datasets") == 1.8
    assert b("x", "architecture", "Proposed Method") == 1.3
    assert b("fusion loss", "general", "Loss terms") == 1.3
    assert b("x y", "config", "Abstract") == 1.0


@pytest.mark.parametrize(
    ("text", "paper", "section", "table"),
    [
        ("see 2507.10864v3 Section 2.3", "2507.10864v3", "2.3", None),
        ("the SamNet paper, Table 2", "SamNet", None, "Table_2"),
        ("Table_2", None, None, None),
        ("第3.1节 表 4", None, "3.1", "Table_4"),
        ("2.3 attention", None, "2.3", None),
        ("related work", None, "Related Work", None),
        ("nothing", None, None, None),
    ],
)
def test_references(spark, text, paper, section, table):
    refs = routing.references(lit(text))
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in refs.items()]).first()) == (paper, section, table)


def test_router(spark):
    sources = spark.createDataFrame([("Polyp_Segmentation_Transformer.pdf",), ("Sam_2_Medical_Images.pdf",), ("Graph_Networks.pdf",), ("Graph_Models.pdf",)], "source string")
    questions = spark.createDataFrame([(0, "what does polyp segmentation say"), (1, "SAM-2 on medical data"), (2, "graph"), (3, "why")], "query_id long, text string")
    got = {r["query_id"]: r["source"] for r in routing.filename_router(questions, sources).collect()}
    assert got == {0: "Polyp_Segmentation_Transformer.pdf", 1: "Sam_2_Medical_Images.pdf"}


def test_tiers_and_lock(spark):
    kind = "query_id long, chunk_id long, score double, source string, section_id string, table_id string, paper_ref string, section_ref string, table_ref string"
    data = [
        (0, 1, 1.0, "A.pdf", "2.3", None, "a", "2.3", None),
        (0, 2, 2.0, "A.pdf", "1", None, "a", "2.3", None),
        (0, 3, 3.0, "B.pdf", "2.3", None, "a", "2.3", None),
        (1, 1, 1.0, "B.pdf", "1", "Table_2", "a", None, "Table_2"),
        (1, 2, 2.0, "B.pdf", "1", "Table_3", "a", None, "Table_2"),
        (2, 5, 1.0, "B.pdf", "1", None, "a", None, None),
        (3, 5, 1.0, "B.pdf", "1", None, None, "9", None),
    ]
    df = spark.createDataFrame(data, kind)
    assert sorted((r["query_id"], r["chunk_id"], r["tier"]) for r in routing.tiers(df).collect()) == [(0, 1, 2), (1, 1, 1), (3, 5, 5)]
    assert sorted((r["query_id"], r["chunk_id"]) for r in routing.table_lock(df).where("query_id = 1").collect()) == [(1, 1)]


def test_numbered_is_dense(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"))
    got = sorted((r["k"], r["idx"]) for r in relational.numbered(df, ["k"], base=5).collect())
    assert got == [(i, i + 5) for i in range(1000)]


def test_resolve_order(spark):
    wanted = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e")], "archive_id string, stem string")
    files = spark.createDataFrame([("2.pdf",), ("c.pdf",), ("d_2.pdf",), ("d_3.pdf",), ("1.pdf",)], "file string")
    manifest = spark.createDataFrame([("1", "kept.pdf")], "archive_id string, file string")
    assert {r["archive_id"]: r["file"] for r in relational.resolve(wanted, files, manifest).collect()} == {"1": "kept.pdf", "2": "2.pdf", "3": "c.pdf", "4": "d_2.pdf", "5": None}


def test_bundle(spark):
    chunks = spark.createDataFrame([(1, "p", "2", "Datasets", 0), (2, "p", "2", "Datasets", 1), (3, "p", "3", "Other", 2), (4, "p", "3", "Other", 3)], "chunk_id long, source string, section_id string, section_title string, idx long")
    hits = spark.createDataFrame([(0, 1, 0.7), (0, 3, 0.5)], "query_id long, chunk_id long, score double")
    assert rows(relational.bundle_sections(hits, chunks, ["source", "section_id"])) == [(0, 1, 0.7), (0, 2, 0.0), (0, 3, 0.5)]


def test_dedup_index_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, None)], "id long, idx long")
    assert rows(relational.dedup_index(df, "idx", [F.col("id")]).select("id")) == [(1,), (3,), (4,)]


PAPER = """Abstract
short
II. METHODS AND DATA
""" + "Some words about the method. " * 6 + """
A. Dataset
""" + "Images from three clinics were used. " * 6 + """
1999 Noise of a year
2.1 Training setup
""" + "We train for many epochs with care. " * 6 + """
References
[1] Someone. Something that is long enough to be kept if it were not skipped by its title alone, certainly."""


def test_sections(spark):
    df = spark.createDataFrame([("p", PAPER)], "source string, full_text string")
    got = [(r["section_id"], r["title"], r["level"]) for r in chunking.sections(df).orderBy("start").collect()]
    assert got == [
        ("Abstract", "Abstract", 0),
        ("II", "II. METHODSANDDATA", 1),
        ("II.A", "II. METHODSANDDATA - A. Dataset", 2),
        ("II.2.1", "II. METHODSANDDATA - 2.1 Training setup", 2),
    ]


@pytest.mark.parametrize("line", ["", "1999 Year", "20000 Things", "a sentence.", "V. mostly lower case", "A. Zhang, B. Li, and others", "B. In 2019 it was", "Model loss 50%", "Data 3/4 split", "Table 2 data set", "Data set used:", "x" * 200, "1. lower case"])
def test_no_heading(spark, line):
    assert one(spark, chunking.heading(lit(line))) is None


def test_packing_covers_paragraphs(spark):
    paragraphs = [f"paragraph number {i} with several words in it" for i in range(40)]
    df = spark.createDataFrame([(1, "\n".join(paragraphs)), (2, None), (3, "tiny")], "id long, text string")
    got = chunking.chunk(df, ["id"], "text", separator="\n", size=60, overlap=5).orderBy("id", "ordinal").collect()
    joined = "\n".join(r["text"] for r in got)
    assert all(p in joined for p in paragraphs) and {r["id"] for r in got} == {1} and all(r["tokens"] <= 75 for r in got)


def test_weak_headings(spark):
    text = "\n".join(["Training loss", "x", "Model setup", "x", "x", "x", "x", "Data used", "x"])
    df = spark.createDataFrame([("p", text)], "source string, full_text string")
    got = [(r["start"], r["title"], r["number"]) for r in chunking.sections(df, min_chars=1).orderBy("start").collect()]
    assert got == [(0, "Training loss", 1), (7, "Data used", 2)]


def test_metrics(spark):
    results = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "a", 3), (1, "z", 1)], "query_id long, key string, rank long")
    qrels = spark.createDataFrame([(0, "a"), (0, "c"), (1, "y")], "query_id long, key string")
    got = {r["query_id"]: r for r in quality_of_search.metrics(results, qrels, (5,)).collect()}
    assert (got[0]["recall_raw_5"], got[0]["recall_5"], got[0]["mrr_5"]) == (1.0, 0.5, 1.0)
    assert (got[1]["recall_5"], got[1]["mrr_5"], got[1]["ndcg_5"]) == (0.0, 0.0, 0.0)


def test_listwise_rerank_falls_back(spark):
    c = spark.createDataFrame([(0, "q", i, 1.0 - i / 10, f"t{i}") for i in range(5)], "query_id long, question string, chunk_id long, score double, text string")
    turned = quality_of_search.listwise_rerank(c, lambda q, t: list(range(len(t)))[::-1], pool=3)
    assert {r["chunk_id"]: r["final_rank"] for r in turned.collect()} == {2: 1, 1: 2, 0: 3, 3: 4, 4: 5}
    wrong = quality_of_search.listwise_rerank(c, lambda q, t: [0], pool=3)
    assert {r["chunk_id"]: r["final_rank"] for r in wrong.collect()} == {i: i + 1 for i in range(5)}


def test_rewrites_keep_the_original(spark):
    df = spark.createDataFrame([(0, 0, "two words"), (0, 1, "a b"), (0, 2, "One two three"), (0, 3, "one TWO three"), (0, 4, "x y z w")], "query_id long, pos long, text string")
    assert [r["text"] for r in dialogue.distinct_rewrites(df).orderBy("place").collect()] == ["two words", "One two three", "x y z w"]


def test_entities(spark):
    df = spark.createDataFrame([(1, 0, "user", "Compare UNet and ResNet, Table 3"), (1, 1, "assistant", "UNet has 91.5% accuracy in Table_3")], "conv_id long, turn long, role string, text string")
    got = {(r["kind"], r["entity"], r["first_seen"]) for r in dialogue.entities(df).collect()}
    assert got == {("method", "UNet", 0), ("method", "ResNet", 0), ("table", "Table_3", 0), ("metric", "91.5% accuracy", 1)}
