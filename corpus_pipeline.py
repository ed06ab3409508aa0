"""The corpus pipeline: language identification, near-duplicate removal, mixing to target weights,
packing. Every stage takes all rows that the one before kept; each stage's decisions take effect in
the rows that it returns; all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, own_prefix
from strandloom.llm.language_id import UNDETERMINED, fold_of, identify, train
from strandloom.llm.ngram_join import similar_documents
from strandloom.llm.packing import best_fit_packing
from strandloom.llm.source_mix import document_levels, mix_sources, smoothed


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; what has no letters at all goes. A missing label is filled in."""
    columns = docs.columns
    model = train(docs.where(F.coalesce(fold_of("doc_id", 4) != 2, F.lit(False))))
    kept = identify(docs, model).where(F.col("lang_pred") != UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; repeated rows
    once."""
    found = similar_documents(docs, Scratch(spark, "near"))
    first = found.where("id = component").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    key = f"{own_prefix(docs.columns)}text"
    return kept.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the smoothed weights, a row for each pass that takes one."""
    return mix_sources(docs, document_levels(), smoothed(0.7)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    out = best_fit_packing(docs, Scratch(spark, "packed"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", without_near_duplicates),
    ("source_mix", mixed),
    ("best_fit_packing", packed),
]

#: SQL cannot express suffix automata, or best-fit packing; tests/llm/test_pipeline.py compares each
#: stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a table that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
