from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm.oracles import oracle_sql, template_regex
from quillspark.llm.queries import queries

from .conftest import frame
from .test_licenses import TEXTS as LICENSES
from .test_secrets import TEXTS as SECRETS
from .test_secrets import mixed


@pytest.fixture(scope="module")
def folder(spark, pairs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [*pairs, *((2000 + i, t) for i, t in enumerate([*SECRETS, *LICENSES, *mixed(23, 150)]))]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(2, F.col("doc_id")).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got = queries()[name](spark, folder)
    found = con.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*sorted(names)).collect()), key=str) == want


def test_template_regex():
    assert template_regex("a [[b]] (( c | d e )) {{2}}") == " a(?: b)?(?: c| d e)(?: [^ ]+){0,2} "
