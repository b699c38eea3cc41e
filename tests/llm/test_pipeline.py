"""The pipeline: every stage on its own input against a plain version of it, odd rows, empty tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import check_tokens, exact_leaks, plain_language, plain_markov, plain_near_copies, plain_spans

import corpus_pipeline
from setforge.llm import langid, secrets
from setforge.llm.common import _under_way
from setforge.scratch import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_counts(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_language_stage(stages):
    before, after = rows(stages[0]), rows(stages[1])
    model = langid.train(stages[0].select("text", "lang"))
    exp = set()
    for k, r in enumerate(sorted(before.values(), key=lambda r: len(r.text or ""))):
        text = (r.text or "").encode()
        if any(c.isalpha() for c in r.text or ""):
            p = plain_language(model, text) if k < 25 else langid.predict(model, [text])[0]
            if max(p) >= corpus_pipeline.LEAST_OVER_CHANCE / len(model.labels):
                exp.add(r.doc_id)
    assert set(after) == exp and all(after[i] == before[i] for i in exp)


def test_near_duplicates_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    least = plain_near_copies([(r.doc_id, r.text) for r in before.values()])
    assert set(after) == {i for i, c in least if i == c} < set(before)
    assert all(after[i] == before[i] for i in after)


def test_benchmark_stage(spark, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(before)
    found = {ids[d] for d, _, _ in exact_leaks(items, [before[i].text for i in ids])}
    assert found and set(after) == set(before) - found and all(after[i] == before[i] for i in after)


def test_secret_scan_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    ratios = secrets.train(stages[3])
    changed = 0
    for i, r in before.items():
        text = r.text or ""
        base = plain_spans(text)
        mask = np.zeros(len(text), bool)
        for a, b in [(a, b) for a, _, b, _ in base] + plain_markov(text, base, ratios):
            mask[a:b] = True
        exp = "".join("[SECRET]" if m and not (k and mask[k - 1]) else "" if m else text[k] for k, m in enumerate(mask))
        assert (after[i].text or "") == exp
        assert after[i].n_chars == (len(exp) if mask.any() else r.n_chars)
        changed += bool(mask.any())
    assert changed and set(after) == set(before)


def test_tokens_stage(stages):
    check_tokens(stages[4])
    assert sorted(rows(stages[5])) == sorted(rows(stages[4]))


def test_near_copies_go(spark):
    """Copies with and without an id, edited copies, repeated rows, and several texts under one id."""
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    edited = ["edited" if k in (50, 120, 190, 260) else w for k, w in enumerate(words)]  # shares 276 of 316 shingles
    text, other, lone = " ".join(words), " ".join(reversed(words)), "only rows without an id have this text"
    docs = spark.createDataFrame([(1, text), (2, " ".join(edited)), (3, other), (3, other), (1, "another text of id one"), (None, text), (None, lone), (None, lone)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([(1, text), (3, other), (1, "another text of id one"), (0, lone)])


def write_tables(spark, docs, path):
    docs.write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(path / "benchmark.parquet"))


def test_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns, through every stage and the whole."""
    write_tables(spark, odd, tmp_path)
    got = sorted((r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert [i for i in got if i != 8] == [0, 4, 5, 7]  # without letters or copies; one of the rows without an id has a text of its own
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns


def test_empty_tables_and_one_label(spark, none, tmp_path):
    write_tables(spark, none, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "some text", "en"), (2, "12", "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
    assert corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_what_stages_store_on_their_way_goes(spark, tmp_path):
    write_tables(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    shared = re.sub("^file:(//)?(?=/)", "", shared_dir(spark))
    before = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0 and not _under_way
    assert len(set(os.listdir(shared)) - before) == 1  # the input of the last stage


def test_columns_of_any_name_stay(spark, tmp_path):
    """Names that stages use themselves are columns like others."""
    odd = ["__t", "__new", "__score", "__lang", "__last", "__id", "__base", "__spans", "__bytes"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in odd])
    exp = {r.doc_id: tuple(r[c] for c in odd) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert out.columns == docs.columns and got and all(tuple(r[c] for c in odd) == exp[r.doc_id] for r in got)
