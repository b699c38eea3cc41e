"""Queries of the subpackage that SQL can express, against DuckDB."""

import duckdb
import pytest

from setforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(df.select(*cols).collect()) == key(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}


def test_secret_scan_sql_of_a_sample(spark):
    """Beyond SAMPLE_ROWS the SQL counts the same sample."""
    from setforge.llm import secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = secrets.scan(docs, secrets.train(docs, rows=60)).select("doc_id", secrets.joined("spans"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = secrets.SQL.replace(f"{secrets.SAMPLE_ROWS} /", "60 /")
    assert sorted(map(tuple, got.collect())) == con.sql(f"select doc_id, spans from ({sql}) order by 1").fetchall()
