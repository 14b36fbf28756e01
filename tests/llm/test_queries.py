"""Registered queries: all are there, and those with SQL equal it."""

import duckdb
import pytest

import __spark_entry__ as entry
from sigtide.llm import queries as q

TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_all_operators_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(q.oracle_sql()) <= set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
