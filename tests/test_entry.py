"""The registry: every SQL text has its query, columns agree, and results match DuckDB on the smallest tables where they are there."""

import datetime
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str([norm(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_result_is_that_of_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SMALL}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't here")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc", "n_categories", "n_entities", "score"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {n for n in entry.queries() if n[0] == "p" and n[1:2].isdigit()}))
def test_queries_without_sql_run(spark, name):
    import hashlib

    assert name == "text_digests"  # the only one that SQL can't say
    texts = {r.id: r.text for r in spark.read.parquet(f"{SMALL}/news_analytics.parquet").select("id", "text").collect()}
    got = {r.doc: r.digest for r in entry.queries()[name](spark, SMALL).collect()}
    assert got == {i: None if t is None else hashlib.sha3_512(t.encode()).hexdigest() for i, t in texts.items() if i is not None}
