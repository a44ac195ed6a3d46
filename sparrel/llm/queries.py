"""The queries of the operators, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm import bpe, chat, embeddings, html, jaccard, packing, urls
from sparrel.llm.common import saved, table
from sparrel.llm.langid import fit_languages, with_language
from sparrel.llm.media import media_digests
from sparrel.llm.quality import fit_quality, with_quality


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def _held_out(n: int, rest: int) -> Column:
    return F.coalesce(_remainder(n) == rest, F.lit(False))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), _remainder(4) != 2)
    return with_quality(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, _remainder(5) != 0)
    scored = with_language(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = saved(packing.pieces(table(spark, sf_dir, "documents"), ids=False), "pieces")
    return packing.pack(cut)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media, op2_quality, op3_language, op4_html, op5_urls, op6_jaccard, op7_bpe, op8_packing, op9_chat, op10_embeddings)}

_COMPONENTS = """
reach(node, other) as (
  select a, b from linked union select b, a from linked
  union select r.node, l.b from reach r join (select a, b from linked union all select b, a from linked) l on r.other = l.a),
joined as (select node, min(least(node, other)) as component from reach group by node)
"""

SQL: dict[str, str] = {
    "op6_jaccard": rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from words),
sized as (select doc_id, len(s) as n, s from shingled),
postings as (select doc_id, n, unnest(s) as t from sized),
linked as (
  select x.doc_id as a, y.doc_id as b from postings x join postings y on x.t = y.t and x.doc_id < y.doc_id
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{_COMPONENTS}
select doc_id, cast(n as bigint) as n_shingles, coalesce(component, doc_id) as component_id from sized left join joined on node = doc_id
""",
    "op9_chat": chat.SQL,
    "op10_embeddings": f"""
with recursive vectors as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
linked as (
  select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.label = y.label and x.vec_id < y.vec_id
  where list_cosine_similarity(x.e, y.e) >= 0.98),
{_COMPONENTS},
counted as (select node, count(*) as n from (select a as node from linked union all select b from linked) group by node)
select vec_id, coalesce(n, 0) as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from vectors left join joined j on j.node = vec_id left join counted c on c.node = vec_id
""",
}
