"""From raw documents to packed training sequences, stage by stage.

Defined results, of every stage: an empty table gives an empty table; all columns but text and n_chars
come back unchanged, whatever their names (the last stage returns pieces). Null and empty texts are
rejected by the first stage; a stage that meets them by itself treats them as said there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicq.llm import decontam, line_dedup, ngram_join, packing, quality
from mosaicq.workspace import discard, fresh_path, scratch

#: SQL has no fuzzy search of benchmark items, connected components or packing: see tests/llm/test_corpus_ops.py.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them; repeated rows are judged alike."""
    return quality.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; n_chars follows the text.

    Null texts stay null; repeated rows count as pages; a null source is a source.
    """
    out = line_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once.

    Ties of ids are decided by a hash of the text; of exactly repeated rows one stays; documents without
    words are like no other and stay.
    """
    def key(table: str) -> Column:
        return F.struct(F.col(f"{table}.doc_id"), F.xxhash64(f"{table}.text").alias("h"))

    docs = docs.alias("d")
    near = ngram_join.near_duplicates(docs.select(key("d").alias("key"), "d.text"), id_col="key")
    stay = near.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key").agg(F.count("*").alias("n"))
    left = docs.join(stay.alias("s"), key("d").eqNullSafe(F.col("s.key")), "left_semi")
    repeated = not stay.where("n > 1").isEmpty()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none; without items all stay."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences; null and empty texts are the end id alone, repeated rows are packed each."""
    return packing.pack(docs).drop("row")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what its predecessor kept, written and read again in between; what is read no more is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
