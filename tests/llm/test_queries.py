"""Every query of the subpackage runs on the smallest tables; those with SQL give what DuckDB gives."""

import os

import duckdb
import pytest

from quarry.llm.queries import ORACLE, QUERIES

FOUND = {"p1": ["keep_id", "id"], "p2": ["chunk_id", "field", "kind"], "p5": ["field", "row_id", "start_at"], "p7": ["word", "mark"], "p8": ["container_id", "doc_id"], "p9": ["item_id", "doc_id"], "p10": ["doc_id", "kind", "start_at"]}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, name):
    got = QUERIES[name](spark, data)
    if name.endswith("_found"):
        assert got.columns == FOUND[name.removesuffix("_found")]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
        names = [d[0] for d in con.execute(ORACLE[name]).description]
        want = [tuple(dict(zip(names, r))[c] for c in got.columns) for r in con.execute(ORACLE[name]).fetchall()]
        assert rows == sorted(want, key=str)
