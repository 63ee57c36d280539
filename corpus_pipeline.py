"""A training corpus from ``documents``: quality filter, near-duplicates, repeated passages, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns
the next one's documents, the last the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_dedup, packing, quality, suffix_dedup
from tessera.llm.entry import WORD_BPE
from tessera.llm.shared import Scratch, free, small


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Every row is scored by its whole text alone: repeated rows and rows without a
    doc_id alike, null and empty texts as texts without words.  Without usable labels
    every score is a half, which keeps all.  An empty table stays empty.
    """
    return quality.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, null after all others.

    Rows are told apart by doc_id and text, not by doc_id alone.  Rows that repeat both
    are one document, whatever their other columns hold: any one of them stays.  Texts
    that share a doc_id, or have none, are documents of their own: each is joined to its
    own near-duplicates, and one that is like no other stays.  Of a group's texts with
    the same doc_id, the one with the smallest key stays.  Null texts and those without
    words are like no other.  An empty table stays empty; columns of any name are kept.
    The keys are 64-bit hashes of doc_id and text: among ten million rows, any two share
    one with probability 3e-6.
    """
    scratch = Scratch(spark)
    key = free("_key", docs)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    again = scratch.keep(keyed.groupBy(key).count().filter("count > 1").select(key), "again")
    # Only repeated rows are dealt by key; a key's copies are reduced before they travel.
    once = scratch.keep(keyed.join(small(again, 8), key, "left_semi").select(keyed.columns).dropDuplicates([key]), "once")
    rows = keyed.join(small(again, 8), key, "left_anti").select(keyed.columns).unionByName(once)

    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id"))
    found = scratch.keep(found.join(ids, "key"), "found")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("key"))
    gone = scratch.keep(found.join(first, "key", "left_anti").select(F.col("key").alias(key)), "gone")
    return rows.join(small(gone, 8), key, "left_anti").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur anywhere else, wherever they occur.

    Every row stays: one whose text is all repeated has an empty text, a null text
    stays null, and repeated rows are each other's repetition.  Rows without a doc_id
    are texts like any.  Very long texts are cut whole.  An empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece of a document.

    Null and empty texts are one token each, repeated rows are packed each, a null
    doc_id stays null, and only texts of over 2048 tokens are cut.  Equal lengths are
    packed in order of doc_id.  An empty table gives no rows; other columns go.
    """
    return packing.pack_documents(docs, WORD_BPE, 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Classifier, sketches and packing are beyond SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
