"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    order = lambda row: tuple(map(str, row))
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=order)
    have = sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=order)
    assert have == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rank_pool15_keeps_ties_of_four_places(spark, tmp_path):
    """200 near copies, the nearer the greater their id."""
    near = [(i, [1.0, i * 4e-5], 0) for i in range(200)]
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(catalogue.SQL["rank_pool15"]).fetchall())
    assert sorted(tuple(r) for r in catalogue.QUERIES["rank_pool15"](spark, str(tmp_path)).collect()) == want
