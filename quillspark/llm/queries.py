"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import spread

from .oracles import oracle_sql  # noqa: F401


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), window=2048, separator=1)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join

    return join(_documents(spark, sf_dir), k=5, threshold=0.8).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_table

    coded = encode_table(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(_documents(spark, sf_dir), reach=200)).withColumnRenamed("id", "doc_id")


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import written
    from .cotrain import features, fit, scores

    feats = written(features(_documents(spark, sf_dir)), "features")
    return scores(feats, fit(feats, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumnRenamed("id", "doc_id")


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .editcount import edited, header, redactions, trees

    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    # One batch of edits after the other, each on the trees that the one before left.
    first = trees(_documents(spark, sf_dir), *how).withColumn("n_pretokens", (F.octet_length("lengths") / 4).cast("long"))
    masked = edited(first, *how, redactions, ["n_pretokens"]).withColumnsRenamed({"n_before": "n_tokens_first", "n_edits": "n_edits_first", "n_reencoded": "n_reencoded_first"})
    both = edited(masked, *how, header, ["n_pretokens", "n_tokens_first", "n_edits_first", "n_reencoded_first"])
    return both.select(
        F.col("id").alias("doc_id"), "n_pretokens", F.col("n_tokens_first").alias("n_tokens"), F.col("n_edits_first").alias("n_edits"), F.col("n_reencoded_first").alias("n_reencoded"), F.col("n_before").alias("n_tokens_after"),
        F.col("n_edits").alias("n_edits_second"), F.col("n_reencoded").alias("n_reencoded_second"), F.col("n_tokens").alias("n_tokens_second"), F.char_length("text").cast("long").alias("n_chars_after"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import strip_repeats

    found = strip_repeats(_documents(spark, sf_dir), window=35)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_back, store

    return read_back(store(_documents(spark, sf_dir), unit=576)).withColumnRenamed("id", "doc_id")


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .fertility import judge

    judged = judge(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col("id").alias("doc_id"), *first, "lang", "n_tokens", "chars_per_token", "byte_share", "entropy", "pair_chars_per_token", "pair_byte_share", "failed_band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_cotraining": op2_cotraining,
        "op3_edit_counts": op3_edit_counts,
        "op4_packing": op4_packing,
        "op5_license_scan": op5_license_scan,
        "op6_substrings": op6_substrings,
        "op7_media_sniffing": op7_media_sniffing,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_fertility": op10_fertility,
    }
