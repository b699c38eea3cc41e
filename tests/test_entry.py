"""The driver contract: queries equal their SQL on DuckDB; all works without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry
from setforge import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(df.select(*cols).collect()) == key(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_empty_files_beside_empty_documents(spark, tmp_path):
    """They have the digest of a rom, as a document is empty or null, but are no file of the catalogue."""
    con = duckdb.connect()
    con.execute(f"copy (select doc_id, case doc_id when 3 then '' when 4 then null else text end as text, lang, source from '{SF}/documents.parquet' where doc_id < 40) to '{tmp_path}/documents.parquet' (format parquet)")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = set(con.sql(entry.oracle_sql()["store_scanned_files"]).select("path, sha1, known").fetchall())
    got = entry.queries()["store_scanned_files"](spark, str(tmp_path)).select("path", "sha1", "known").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert {r.known for r in got if r.path.endswith("/_empty")} == {False}


def test_queries_without_sql(spark):
    assert set(own.queries()) - set(own.oracle_sql()) == {"xxh3_digests"}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.xxh3 for r in entry.queries()["xxh3_digests"](spark, SF).collect()}
    assert got == {i: xxhash.xxh3_64_hexdigest(x.encode()).upper() for i, x in texts.items()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "setforge"), tmp_path / "setforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_bundle_summary' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
