from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import cotrain
from quillspark.llm.cotrain import Batch, CoTrained, Extractor, Logistic, classify, features, fit, keep_good, pseudo_sums, train

from .conftest import frame

SF = "/root/testdata/sf0.01"


def accuracy(docs, labels, model):
    """Shares of right verdicts of the text view, the metadata view and both, and of good documents kept."""
    judged = classify(docs, model).join(labels, F.col("id") == F.col("doc_id"))
    right = [F.avg(((F.col(c) >= 0.5) == (F.col("quality") == 1)).cast("double")) for c in ("text_score", "meta_score", "score")]
    return judged.select(*right, F.sum((F.col("kept") & (F.col("quality") == 1)).cast("int")) / F.sum("quality")).first()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.hash("doc_id"), F.lit(2))
    model = train(docs, labels.where(part == 0))
    text, meta, both, kept = accuracy(docs, labels.where(part == 1), model)
    assert text > 0.9 and meta > 0.8 and both > 0.93 and kept > 0.97, (text, meta, both, kept)
    again = train(docs.repartition(5), labels.where(part == 0))
    assert (again.models["text"].w == model.models["text"].w).all() and (again.both == model.both).all()
    assert classify(docs, model).count() == docs.count()


def test_without_labels_all_is_kept(spark, docs, none, pairs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = train(docs, labels)
    assert classify(docs, model).where("kept").count() == len(pairs)
    assert keep_good(docs, model).columns == docs.columns and keep_good(docs, model).count() == len(pairs)
    assert classify(none, train(none, labels)).count() == 0


def test_kept_rows_are_those_of_the_scores(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.001/" + t + ".parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    kept = {r["id"] for r in classify(docs, model).where("kept").collect()}
    assert {r["doc_id"] for r in keep_good(docs, model).collect()} == kept and 0 < len(kept) < docs.count()
    odd = docs.withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, float("inf")).when(F.col("doc_id") % 3 == 1, float("nan")).otherwise(F.col("n_chars").cast("double")))
    assert {r["doc_id"] for r in keep_good(odd, model).collect()} == {r["id"] for r in classify(odd, model).where("kept").collect()}


def plain(text: str | None, lang, source, chars):
    """Features of one document, one by one."""
    extract = Extractor()
    return Batch.of_columns(*extract([lang], [source], [chars], [(text or "").encode()]))


def test_sums_equal_a_plain_version(spark, docs, pairs):
    """Every row counts: the sums of all partitions are those of the documents one after another."""
    rnd = np.random.default_rng(3)
    model = CoTrained(0.5)
    model.models = {v: Logistic(v) for v in cotrain.VIEWS}
    for v, m in model.models.items():
        m.w, m.b = rnd.normal(size=m.size), 0.1
        model.own[v] = np.array([2.0, -0.1])
    got = pseudo_sums(features(docs), model, 0.8)
    want = {(v, k): [0, 0.0, 0.0] for v in cotrain.VIEWS for k in (0, 1)}
    for i, t in pairs:
        batch = plain(t, None if i is None else "en", "s", None if t is None else len(t))
        p = {v: 1 / (1 + np.exp(-(2 * batch.margin(v, m.w, m.b)[0] - 0.1))) for v, m in model.models.items()}
        for view, other in (("text", "meta"), ("meta", "text")):
            for kind in (0, 1):
                if (p[other] if kind else 1 - p[other]) >= 0.8:
                    m = model.models[view]
                    error = 1 / (1 + np.exp(-batch.margin(view, m.w, m.b))) - kind
                    held = want[view, kind]
                    for j, part in enumerate(batch.sums(view, error, np.array([True]))):
                        held[j + 1] = held[j + 1] + part
                    held[0] += 1
    assert sum(w[0] for w in want.values()) > 40
    for (v, k), (n, g, h) in want.items():
        if n:
            assert got[v][k][0] == n
            assert (got[v][k][1] == g).all() and (got[v][k][2] == h).all()
        else:
            assert k not in got[v]


@pytest.mark.parametrize("view", cotrain.VIEWS)
def test_curvature_is_a_bound(view):
    """Along any direction a document's loss lies below the gradient and the curvature that stand for it."""
    rnd = np.random.default_rng(1)
    batch = plain("Some words here, and some Words there.\nA line\nA line", "en", "src1", 50)
    size = cotrain.TEXT_SIZE if view == "text" else cotrain.META_SIZE
    w, b = rnd.normal(size=size), 0.3
    loss = lambda w, b: np.log1p(np.exp(-batch.margin(view, w, b)[0]))
    error = 1 / (1 + np.exp(-batch.margin(view, w, b))) - 1
    g, h = (x / cotrain.FIXED for x in batch.sums(view, error, np.array([True])))
    for _ in range(50):
        d = rnd.normal(size=size + 1) * rnd.choice([0.01, 1, 5])
        assert loss(w + d[:-1], b + d[-1]) <= loss(w, b) + g @ d + 0.5 * h @ d**2 + 1e-3


def test_repeated_ids_and_ties(spark):
    """A labelled id on thousands of rows is one row of the sample; equal rows are scored alike."""
    rows = [(i % 40, ("good words of prose here " * 20 if i % 2 else "## $$ junk || ") + str(i % 7)) for i in range(4000)] + [(7, "x")] * 500 + [(None, "x")] * 5
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (5, 0)], "doc_id long, quality int")
    feats = features(docs)
    model = fit(feats, labels, sample=30)
    assert model.both is not None
    got = classify(docs, model).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["id"] is None}) == 1


def test_exchange_teaches_the_other_view(spark):
    """The sample tells nothing of metadata; the text view's labels of all others do."""
    rnd = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(1600):
        good = int(rnd.random() < 0.5)
        labelled = i < 400
        text = " ".join(rnd.choice(["alpha", "beta", "gamma"] if good else ["rho", "sigma", "tau"], 60))
        rows.append((i, text, "en" if labelled else ("aa" if good else "zz"), "s", 300))
        if labelled:
            marks.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    shown = [("", "aa", "s", 300), ("", "zz", "s", 300)]
    apart = []
    for rounds in (0, 3):
        model = train(docs, labels, rounds=rounds)
        m = model.models["meta"]
        good, bad = (plain(*x).margin("meta", m.w, m.b)[0] for x in shown)
        apart.append(good - bad)
    assert apart[1] > apart[0] + 0.2, apart
