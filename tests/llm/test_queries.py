"""Queries on the smallest tables, exact columns of the found ones, SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

from seogo.llm.queries import QUERIES, SQL

FOUND = {
    "p1_found": [("block_id", "bigint"), ("line_no", "bigint")], "p2_found": [("item_kind", "string"), ("item_id", "string"), ("forced", "bigint")],
    "p3_found": [("place", "string"), ("record_id", "string"), ("start_pos", "bigint"), ("pii_type", "string")], "p4_found": [("item_kind", "string"), ("id_a", "string"), ("id_b", "string")],
    "p5_found": [("chunk_id_a", "string"), ("chunk_id_b", "string")], "p6_found": [("item_kind", "string"), ("item_id", "string")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_keeps_its_columns(spark, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    assert got
    if name in FOUND:
        assert df.dtypes == FOUND[name] and len(set(got)) == len(got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, rows, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, data)
    want = con.sql(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert rows(df) == sorted(want, key=str)
