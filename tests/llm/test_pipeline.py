from __future__ import annotations

import numpy as np
import public_tokenizers
import zlib

import corpus_pipeline
from quillspark.llm import cotrain, secrets
from quillspark.llm.packing import WordTokens
from quillspark.llm.queries import oracle_sql, queries

from .test_jaccard import brute as jaccard_brute
from .test_secrets import base
from .test_substrings import brute as repeats_brute

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]
    stages = list(stages.values())

    good = stages[0](spark, docs, SF)
    judged = cotrain.classify(docs, cotrain.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["id"] for r in judged.where("kept").collect()}

    good.write.parquet(str(tmp_path / "1"))
    good = spark.read.parquet(str(tmp_path / "1"))
    one = stages[1](spark, good, SF)
    pairs = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({x[1] for x in jaccard_brute(pairs, 0.8)})

    one.write.parquet(str(tmp_path / "2"))
    one = spark.read.parquet(str(tmp_path / "2"))
    rows = one.collect()
    want = {}
    for r, (n, gone, kept) in zip(rows, repeats_brute([r["text"] for r in rows], 35)):
        if not gone or gone < n:
            want[r["doc_id"]] = kept if gone else r["text"]
    cut = stages[2](spark, one, SF)
    got = cut.collect()
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)

    cut.write.parquet(str(tmp_path / "3"))
    cut = spark.read.parquet(str(tmp_path / "3"))
    safe = stages[3](spark, cut, SF)
    assert safe.columns == docs.columns and safe.count() == cut.count()
    assert not any(base(r["text"]) for r in safe.collect())
    assert secrets.digest(secrets.scan(safe)).where("spans <> ''").count() == 0

    safe.write.parquet(str(tmp_path / "4"))
    safe = spark.read.parquet(str(tmp_path / "4"))
    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict = {}
    for p in stages[4](spark, safe, SF).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    for r in safe.collect():
        ids = np.frombuffer(tokens(r["text"].encode()) + b"\1\0\0\0", "<u4")
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)} and oracle_sql().keys() <= queries().keys()


def test_odd_rows_and_columns(spark, docs, none, tmp_path):
    """Nulls, empty and long texts, equal rows, clashing names; stage after stage, each written and read."""
    labels = [(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    now, before = docs, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, now, str(tmp_path))
        assert made.columns == docs.columns and made.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        made.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        left = now.count()
        assert 0 < left <= before and now.where("kept <> 'x' or spans <> 'x' or tid <> 'x'").isEmpty()
        before = left
        assert stage(spark, none, str(tmp_path)).count() == 0
    pieces = corpus_pipeline.packed(spark, now, str(tmp_path))
    assert pieces.where("start = 0").count() == before
    assert corpus_pipeline.packed(spark, none, str(tmp_path)).count() == 0
