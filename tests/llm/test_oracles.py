"""The SQL-expressible queries against DuckDB; all queries' schemas and row counts."""

import os

import duckdb
import pytest

from stipendlens.llm.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
