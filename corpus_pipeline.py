"""The corpus pipeline: five training-data operators one after another.

Rejected documents go, one document of each near-duplicate class stays, repeated passages are
cut out, secrets are masked, and what is left is packed into training windows.

Defined cases: null text is the empty text to every stage and stays null where nothing is cut or masked; null
ids are values like others; of equal rows one stays; without labels of both kinds every document is kept; a very long text is worked
on whole by every stage, in memory in proportion to it; an empty table gives empty stages; other columns go along unchanged up to packing,
whatever they are called: columns are told apart by place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import cotrain, jaccard, packing, secrets, substrings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    model = cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of the Jaccard join."""
    return jaccard.keep_one(docs, k=5, threshold=0.8)


def _by_place(docs: DataFrame) -> tuple[DataFrame, str, str, str | None]:
    """``docs`` with its columns named by place, and the names of id, text and length (if there is one)."""
    names = docs.columns
    at = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "n_chars") if c in names}
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), at["doc_id"], at["text"], at.get("n_chars")


def _with_text(docs: DataFrame, found: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs``, carried by ``found`` as ``carry0`` and so on, with another text and its length where it has changed."""
    flat, _, at_text, at_chars = _by_place(docs)
    new = {c: F.col(f"carry{i}") for i, c in enumerate(flat.columns)}
    new[at_text] = F.when(changed, text).otherwise(new[at_text])
    if at_chars is not None:
        new[at_chars] = F.when(changed, F.char_length(text).cast(flat.schema[at_chars].dataType)).otherwise(new[at_chars])
    return found.select(*[new[c].alias(c) for c in flat.columns]).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out the words of repeated windows; a text without one stays as it is.

    A document of which no word is left goes.
    """
    flat, at_id, at_text, _ = _by_place(docs)
    found = substrings.strip_repeats(flat, window=35, id_col=at_id, text_col=at_text, carry=flat.columns)
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _with_text(docs, found, F.col("kept"), F.col("n_removed") > 0)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found."""
    flat, at_id, at_text, _ = _by_place(docs)
    found = secrets.scan(flat, reach=200, id_col=at_id, text_col=at_text, carry=flat.columns)
    masked = secrets.masked(found, f"carry{flat.columns.index(at_text)}")
    return _with_text(docs, masked, F.col(f"carry{flat.columns.index(at_text)}"), F.size("spans") > 0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training windows."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, separator=1)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_spans),
    ("packing", packed),
]

#: Classifier, suffix trees and tokenizer are beyond SQL; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
