from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillspark.sources import papers
from quillspark.sources.store import IndexStore
from quillspark.streaming.traces import ingest, rolling_metrics, sessions

PAPERS = [
    {"archive_id": "2401.00001", "title": "Deep nets", "abstract": "nets for polyps", "authors": ["A", "B"], "categories": ["cs.CV"], "published": "2024-05-10T12:00:00+00:00"},
    {"archive_id": "2301.00002", "title": "Old nets", "abstract": "", "authors": [], "categories": ["cs.LG"], "published": "2023-01-01"},
    {"archive_id": "2401.00003", "title": "Trees", "abstract": "no", "categories": None, "published": None},
]


def found(spark, **how):
    spark.dataSource.register(papers.PaperSource)
    df = spark.read.format("papers").option("lines", "\n".join(map(json.dumps, PAPERS))).load()
    return [r["archive_id"] for r in papers.search(df, **how).collect()]


def test_search(spark):
    assert found(spark, terms="nets") == ["2401.00001", "2301.00002"]
    assert found(spark, terms="nets", date_from="2024-01-01") == ["2401.00001"]
    assert found(spark, terms="", date_from="2024-01-01") == ["2401.00001", "2401.00003"]
    assert found(spark, terms="", categories=["cs.LG"]) == ["2301.00002"]
    assert found(spark, terms="nets", sort="submittedDate", descending=False) == ["2301.00002", "2401.00001"]


def test_year(spark):
    spark.dataSource.register(papers.PaperSource)
    df = spark.read.format("papers").option("lines", "\n".join(map(json.dumps, PAPERS))).load()
    assert {(r["archive_id"], r["year"], r["first_author"]) for r in papers.year(df).collect()} == {("2401.00001", 2024, "A"), ("2301.00002", 2023, "Unknown"), ("2401.00003", 0, "Unknown")}


def test_listing_and_manifest(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["file"] for r in papers.listing(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    good, bad = tmp_path / "m.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"files": {"a.pdf": {"arxiv_id": "1234.5678", "title": "T"}}}))
    bad.write_text("{")
    assert [tuple(r) for r in papers.manifest(spark, str(good)).collect()] == [("a.pdf", "1234.5678", "T")]
    assert papers.manifest(spark, str(bad)).count() == 0


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.ensure(0) == (False, "no files and no index") and store.ensure(2)[0]
    chunks = spark.createDataFrame([("My Paper.pdf", 0, "deep nets"), ("My Paper.pdf", 1, "trees"), ("other.pdf", 2, "deep sea"), ("other.pdf", 3, "nothing")], "source string, chunk_id long, text string")
    store.append(chunks.where("source = 'other.pdf'"))
    store.append(chunks.where("source <> 'other.pdf'"))
    store.append_vectors(chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding")))
    store.save_bm25()
    assert store.ensure(0)[0] and store.vectors().count() == 4
    assert sorted(map(tuple, store.sources().collect())) == [("My Paper.pdf", 2), ("other.pdf", 2)]
    assert store.chunks("My Paper.pdf").count() == 2 and store.has("other.pdf") and not store.has("none.pdf")
    from quillspark.operators.search import bm25_search

    queries = spark.createDataFrame([(0, "nets")], "query_id long, text string")
    assert [r["chunk_id"] for r in bm25_search(store.bm25(), queries).collect()] == [0]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make in (("rolling", rolling_metrics), ("sessions", sessions)):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(map(str, spark.table(name).collect()))
        assert got == sorted(map(str, make(events, watermark=None).collect())) and got


def test_ingest_takes_each_source_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    query = ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(r["source"] for r in df.collect()), str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_store_takes_papers_out(spark, tmp_path):
    import pytest

    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    names = [f"p{i}.pdf" for i in range(6)]
    store.append(spark.createDataFrame([(n, i, "text") for i, n in enumerate(names)], "source string, chunk_id long, text string"))
    store.remove("p3.pdf")
    assert sorted(r["source"] for r in store.sources().collect()) == [n for n in names if n != "p3.pdf"]
    store.append_vectors(spark.createDataFrame([(0, [1.0])], "chunk_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="no vector"):
        store.vectors()


def test_build_goes_on(spark, tmp_path):
    from quillspark.functions.text import tokenize
    from quillspark.functions.vectors import hashed_embedding

    body = "Introduction\n" + "\n\n".join("Some words about nets and polyps that go on for long enough. " * 3 for _ in range(3))
    paper = lambda i, text: (f"p{i}.pdf", f"Paper {i}", "", "An abstract." if i % 2 else "", text)
    kind = "source string, title string, archive_id string, abstract string, full_text string"
    store = IndexStore(spark, str(tmp_path / "index"))
    embed = lambda c: hashed_embedding(tokenize(c), 16)
    first = store.build(spark.createDataFrame([paper(1, body), paper(2, "no heading here\n\n" + "x" * 50)], kind), embed)
    again = store.build(spark.createDataFrame([paper(2, body), paper(3, body)], kind), embed)
    rows = store.chunks().orderBy("chunk_id").collect()
    assert first > 2 and again > 1 and [r["chunk_id"] for r in rows] == list(range(first + again))
    assert rows[0]["chunk_type"] == "abstract" and rows[0]["source"] == "p1.pdf" and store.vectors().count() == len(rows)
    assert {r["source"] for r in rows if r["chunk_id"] >= first} == {"p3.pdf"}
    assert store.build(spark.createDataFrame([paper(4, body)], kind), embed, rebuild=True) == store.chunks().count()


def test_small_sources(spark, tmp_path):
    from quillspark.sources import store

    old = spark.createDataFrame([(["one", "two"],)], "corpus array<string>")
    assert sorted(map(tuple, store.old_bm25(old).collect())) == [(0, "one"), (1, "two")]
    path = str(tmp_path / "manifest")
    assert store.load_manifest(spark, path).count() == 0
    store.save_manifest(spark.createDataFrame([("a.pdf", "1", "T")], "file string, archive_id string, title string"), path)
    assert [tuple(r) for r in store.load_manifest(spark, path).collect()] == [("a.pdf", "1", "T")]
    wanted = spark.createDataFrame([("a.pdf", "u1"), ("b.pdf", "bad"), ("c.pdf", "u3")], "file string, pdf_url string")

    def fetch(url):
        if url == "bad":
            raise OSError(url)
        return url.encode()

    files = store.download(wanted, fetch, str(tmp_path / "files"), most=2)
    assert [tuple(r) for r in files.collect()] == [("a.pdf", b"u1")]
    files = store.download(wanted, lambda url: b"new", str(tmp_path / "files"))
    assert {r["file"]: bytes(r["content"]) for r in files.collect()} == {"a.pdf": b"u1", "b.pdf": b"new", "c.pdf": b"new"}
    store.save_results(wanted, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_retry_and_parts(spark, tmp_path):
    spark.dataSource.register(papers.PaperSource)
    df = spark.read.format("papers").option("lines", "\n".join(map(json.dumps, PAPERS))).option("part", "1").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 3
    assert papers.search_or_retry(df, "nets", "nothing at all").count() == 2
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, PAPERS)) + "\n{broken")
    assert papers.read_papers(spark, str(tmp_path / "p.json")).count() == 3


def test_ingest_with_bounded_state(spark, tmp_path):
    docs = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-02 00:00:00")], "source string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(r["source"] for r in df.collect()), str(tmp_path / "state"), stamp="ts").awaitTermination()
    assert sorted(seen) == ["a", "b"]


def _pdf(pages: list[str], packed: bool) -> bytes:
    import zlib

    out = [b"%PDF-1.4"]
    for text in pages:
        body = b"BT /F1 12 Tf (" + text.replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj ET"
        body = zlib.compress(body) if packed else body
        out += [b"1 0 obj << /Type /Page >> endobj", b"2 0 obj << >> stream\n" + body + b"\nendstream endobj"]
    return b"\n".join([*out, b"3 0 obj << /Type /Pages >> endobj", b"startxref 0 %%EOF"])


def test_parsing(spark, tmp_path):
    from quillspark.sources import parsing

    long = "A title of the paper. " * 40
    (tmp_path / "a.pdf").write_bytes(_pdf([long, "page (two) " * 60], True))
    (tmp_path / "b.pdf").write_bytes(_pdf(["short"], False))
    (tmp_path / "c.pdf").write_bytes(b"<html><script>x</script><p>Web &amp; text</p>")
    (tmp_path / "d.pdf").write_bytes(b" ")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["source"]: r for r in parsing.parsed(files, ["broken", "pdf", "html"], {"broken": lambda data: 1 / 0}).collect()}
    assert got["a.pdf"]["engine"] == "pdf" and len(got["a.pdf"]["pages"]) == 2 and got["a.pdf"]["pages"][1].startswith("page (two)")
    assert got["a.pdf"]["title"].startswith("A title") and got["c.pdf"]["full_text"] == "Web & text"
    assert got["d.pdf"]["engine"] is None and got["d.pdf"]["pages"] == []
    counts = {r["path"].rsplit("/", 1)[-1]: r["n"] for r in files.select("path", parsing.page_count(F.col("content")).alias("n")).collect()}
    assert counts == {"a.pdf": 2, "b.pdf": 1, "c.pdf": 0, "d.pdf": 0}
    elements = spark.createDataFrame([("s", 1, 2, "text", "two"), ("s", 1, 1, "text", "one"), ("s", 1, 3, "header", "no"), ("s", 2, 1, "text", "<table> no"), ("s", 2, 2, "table", "<table>")], "source string, page int, nth int, kind string, text string")
    assert parsing.element_text(elements).first()["full_text"] == "one\n\ntwo\n\n<table>"


def test_figures(spark, tmp_path):
    from quillspark.sources import parsing

    picture = b"\xff\xd8\xff" + b"x" * 30_000
    one = b"1 0 obj << /Type /XObject /Subtype /Image /Width 20 /Height 10 /Filter /DCTDecode /P << /A 1 >> >>\nstream\n" + picture + b"\nendstream"
    small = one.replace(b"x" * 30_000, b"y")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n" + small + one + one.replace(b"DCTDecode", b"FlateDecode"))
    (tmp_path / "b.pdf").write_bytes(b"junk")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = parsing.figures(files).select("*", parsing.as_data_address(F.col("image")).alias("address")).collect()
    assert [(r["paper_source"], r["figure_id"], r["width"], r["height"], bytes(r["image"])) for r in got] == [("a.pdf", "Figure_1", 20, 10, picture)]
    assert got[0]["address"].startswith("data:image/jpeg;base64,/9j/")
