"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from countloom.llm import compact_windows, positional_index, quality_rules, simhash, trie_bpe
from countloom.llm.common import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the n-gram ratio go.

    Null and empty texts have no words and go; very long texts are judged whole; repeated rows are judged alike, and each
    counts; without good labels all n-gram ratios are 0, which passes; an empty table stays empty.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Null and empty texts are alike, so one of them stays; very long texts count whole; rows that share the smallest
    doc_id all stay, and so do rows without one; an empty table stays empty.
    """
    return simhash.without_copies(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document (by doc_id) has are cut out; documents without any rest go.

    Null, empty and short texts, and rows without a doc_id, stay as they are; very long texts are compared whole; rows that
    share a doc_id lose the same words; an empty table stays empty.
    """
    return compact_windows.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and empty texts stay; very long texts are searched whole; repeated rows are judged alike; null, empty and
    repeated items are harmless; an empty table stays empty, and an empty benchmark takes nothing.
    """
    return positional_index.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, and digests of ids and decoded text.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows give repeated results.
    """
    return trie_bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, lean=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", repeated_passage_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: No SQL: hashed n-grams, fingerprints, min-hash windows and merges are beyond it; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written as Parquet and read again, and goes once the next is written.

    A run that fails leaves nothing; the last stage's table stays in the checkpoint folder, since the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"

    def delete(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    before = None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before is not None:
                delete(f"{folder}/{before}")
            before = name
    except BaseException:
        delete(folder)
        raise
    return docs
