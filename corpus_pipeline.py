"""A corpus pipeline over ``documents``: language, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.llm import bpe, decontaminate, langid, secrets, similar
from setforge.llm.common import drop_stored, settled, table
from setforge.llm.queries import tokenizer_path
from setforge.operators.ordinals import free_names

#: Documents are rejected whose language has a mean probability below so many times that of a guess among the labels.
LEAST_OVER_CHANCE = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the network tells: not ``und``, and clearly better than by chance."""
    model = langid.train(docs.select("text", "lang"))
    least = LEAST_OVER_CHANCE / len(model.labels) if model and len(model.labels) > 1 else 0.0
    lang, score = free_names(docs.columns, "__lang", "__score")
    out = langid.identify(docs, model, names=(lang, score))
    return out.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: that with the smallest id, rows without an id being last.

    Near copies share 0.8 of their 5-word shingles, directly or through others. Of rows that repeat id and text one
    stays; different texts under one id are documents of their own.
    """
    key = free_names(docs.columns, "__last", "__id", "__t")
    keyed = docs.withColumns(dict(zip(key, [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64("text")])))
    classes = similar.near_copies(keyed.select(F.struct(*key).alias("key"), "text"), id_col="key")
    first = classes.filter(F.col("key") == F.col("component_id")).select("key.*").distinct()
    return keyed.join(first, key, "left_semi").dropDuplicates(key).select(*docs.columns)  # one shuffle of the texts


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text where it changes."""
    base, spans, new = free_names(docs.columns, "__base", "__spans", "__new")
    found = secrets.scan(docs, names=(base, spans)).withColumn(new, secrets.redacted(F.col("text"), F.col(spans)))
    n_chars = F.when(F.size(spans) > 0, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumn("text", F.col(new)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text."""
    return bpe.digests(docs, bpe.read_vocabulary(tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

#: The shingles' hashes, the network and the merges are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back; what a stage stored on its way goes with it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir))
        drop_stored(before)
    return docs
