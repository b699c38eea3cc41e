"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setforge.llm import bpe, chat, decontaminate, html, langid, mixing, mtree, quality, repeats, resampling, secrets, simhash, trie
from setforge.llm.common import spread, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies: in the folder that PUBLIC_TOKENIZERS names, else in the installed package."""
    if own := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(spread(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spread(table(spark, sf_dir, "documents")))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(spread(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(spread(table(spark, sf_dir, "documents")))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(spread(table(spark, sf_dir, "pages")))


def op10_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spread(table(spark, sf_dir, "documents")), bpe.read_vocabulary(tokenizer_path()))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spread(table(spark, sf_dir, "documents")))


OP6_SQL = """
with v as (
  select row_number() over () as nr, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and coalesce(list_sum(list_transform(embedding, lambda x: (1024 * cast(x as double)) * (1024 * cast(x as double)))), 0) < 2305843009213693952.0
),
s as (
  select q.nr, q.vec_id as query_id, v.vec_id,
         cast(list_inner_product(cast(q.v as double[]), cast(v.v as double[])) as bigint) as score
  from v q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id
),
r as (select *, row_number() over (partition by nr order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


OP3_SQL = """
with d as (
  select doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') as w
    , coalesce(cast(doc_id as varchar), md5(text)) as d
  from documents where text is not null
),
p as (select doc_id, d, w, unnest(range(len(w) - 49)) as s from d where len(w) >= 50),
g as (select doc_id, d, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) as k from p),
r as (select k from g group by k having min(d) <> max(d)),
h as (select distinct doc_id, d, s from g where k in (select k from r)),
l as (select *, case when s - lag(s) over (partition by d order by s) <= 50 then 0 else 1 end as first from h),
i as (select *, sum(first) over (partition by d order by s) as island from l),
o as (select doc_id, d, island, min(s) as b, max(s) + 50 as e from i group by 1, 2, 3)
select any_value(doc_id) as doc_id, count(*) as n_passages, cast(sum(e - b) as bigint) as n_words, string_agg(b || ':' || e, ',' order by b) as passages
from o group by d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_tool_calls": op1_chat_tool_calls,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_repeated_passages": op3_repeated_passages,
        "op4_secret_scan": op4_secret_scan,
        "op5_benchmark_leaks": op5_benchmark_leaks,
        "op6_top_k": op6_top_k,
        "op7_simhash_near_duplicates": op7_simhash_near_duplicates,
        "op8_language_id": op8_language_id,
        "op9_html_main_text": op9_html_main_text,
        "op10_bpe_encode": op10_bpe_encode,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_source_mixing": op13_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_tool_calls": chat.SQL, "op3_repeated_passages": OP3_SQL, "op4_secret_scan": secrets.SQL, "op6_top_k": OP6_SQL, "op11_conversation_trie": trie.SQL, "op12_importance_resampling": resampling.SQL, "op13_source_mixing": mixing.SQL}
