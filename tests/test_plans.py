"""Every query with SQL against DuckDB on the smallest tables, and the entry point's promises."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from seogo.plans import cleaning, ingest, retrieval


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


OWN = {**cleaning.SQL, **retrieval.SQL, **ingest.SQL}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_its_sql(spark, data, tables, name):
    got = entry.queries()[name](spark, data).toPandas()
    want = tables.sql(OWN[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    lines = lambda f: sorted(map(str, f[sorted(f.columns)].astype(str).values.tolist()))
    assert lines(got) == lines(want)


@pytest.mark.parametrize("name", ["source_overview", "chunk_documents", "chunk_mail_and_files", "hash_embed", "hybrid_search"])
def test_queries_without_sql_have_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
