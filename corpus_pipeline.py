"""A corpus pipeline of four stages over `documents`: language identification, quality classifier,
near-duplicate removal and packing. Each stage gets what its predecessor kept, written as Parquet and
read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm import jaccard, packing
from sparrel.llm.common import saved, small, table
from sparrel.llm.langid import fit_languages, with_language
from sparrel.llm.quality import fit_quality, with_quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language is a toss-up (posterior under 0.65)."""
    judged = with_language(docs, fit_languages(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= 0.65)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a calibrated score under 0.7."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; of repeated rows
    with one doc_id, one. Rows without doc_id stay."""
    found = saved(jaccard.near_duplicates(docs), "components")
    gone = saved(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack(saved(packing.pieces(docs, ids=False), "pieces"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Model fits have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
