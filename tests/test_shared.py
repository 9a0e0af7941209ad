from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.operators.relational import numbered
from quillspark.shared import discard, lookup, written


def test_numbered_keeps_every_row(spark):
    """More rows than the range sample, columns outside the order, ties."""
    n = 400_000
    rows = spark.range(n, numPartitions=16).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("source"), (F.col("id") * 7919 % 1000).alias("other"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for select, order in ((["doc_id", "source"], ["doc_id"]), (["doc_id", "source", "other"], ["source", "doc_id"]), (["doc_id", "source"], ["source"])):
            got = written(numbered(rows.select(*select), order), "numbers")
            r = got.agg(F.count("*"), F.countDistinct("idx"), F.min("idx"), F.max("idx"), F.countDistinct("doc_id")).first()
            assert tuple(r) == (n, n, 0, n - 1, n), (order, r)
            if order == ["doc_id"]:
                assert got.where("idx <> doc_id").isEmpty()
            else:  # sources follow one another
                spans = got.groupBy("source").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n")).orderBy("source").collect()
                assert all(x.b - x.a + 1 == x.n for x in spans) and [x.a for x in spans] == sorted(x.a for x in spans)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert numbered(rows.limit(0), ["doc_id"]).count() == 0


def test_lookup_splits_hot_keys(spark):
    rnd = random.Random(3)
    keys = [0] * 500 + [rnd.randrange(1, 200) for _ in range(500)] + [None]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    table = rows.where("k < 150").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table, ["k"], how).select("id", "n").collect()))
        assert sorted(map(tuple, lookup(rows, table, ["k"], "n", "id", how, least=10).select("id", "n").collect())) == want


def test_discard(spark):
    table = written(spark.range(10), "gone")
    assert table.count() == 10
    files, other = table.inputFiles(), written(spark.range(0), "empty")
    discard(table, other)
    from pathlib import Path

    assert files and not any(Path(f.removeprefix("file://")).exists() for f in files)
