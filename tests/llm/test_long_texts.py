"""Every operator on a text of megabytes and on a word of one, in time."""

from __future__ import annotations

import random
import time

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, cotrain, editcount, fertility, jaccard, licenses, media, packing, secrets, substrings

from .conftest import frame

PAIRS = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def long(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnoé") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rnd.choice(words) for _ in range(300_000))
    texts = [text, "x" * 1_000_000, text[:1000], text + "\n" + text[:2000], "", None]
    return frame(spark, list(enumerate(texts)))


@pytest.mark.parametrize(("name", "run", "rows"), [
    ("op1", lambda df: secrets.digest(secrets.scan(df)), 6),
    ("op2", lambda df: cotrain.features(df), 6),
    ("op3", lambda df: editcount.count_edited(df, *PAIRS), 6),
    ("op4", lambda df: packing.pack(df, P.path("word_bpe_49k.json")).where("start = 0"), 6),
    ("op5", lambda df: licenses.scan(df), 6),
    ("op6", lambda df: substrings.strip_repeats(df), 6),
    ("op7", lambda df: media.read_back(media.store(df)), 6),
    ("op8", lambda df: jaccard.join(df), 6),
    ("op9", lambda df: bpe.encode_table(df, *PAIRS), 6),
    ("op10", lambda df: fertility.judge(df, P.path("piece_bpe_32k.model"), *PAIRS), 6),
])
def test_in_time(long, name, run, rows):
    began = time.perf_counter()
    got = run(long).collect()
    assert len(got) == rows and time.perf_counter() - began < 60, (name, time.perf_counter() - began)


def test_repeats_of_a_long_text(long):
    gone = {r["id"]: r["n_removed"] for r in substrings.strip_repeats(long).select("id", "n_removed").collect()}
    assert gone[0] >= 300_000 and gone[3] >= 300_000 and gone[2] > 100 and gone[1] == 0
    same = {r["id"]: r["class_id"] for r in jaccard.join(long).where(F.col("id").isin(0, 3, 4, 5)).collect()}
    assert same == {0: 0, 3: 0, 4: 4, 5: 4}
