"""From raw documents to packed training windows: five stages, each a job over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to the
shared folder and reads it back as the next one's docs. All but the last return docs' columns.

Null or empty texts: they are scored like any other, fail the word minimum of the rules, and so go
there. A table without rows passes through. Extra columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import packing, quality_mil, quality_rules, simhash_wide, suffix_dedup
from siltstone.llm._common import drop_table, fresh, held_out, written
from siltstone.llm.queries import PACKED


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_mil.train(docs, labels.filter(~held_out(F.col("doc_id"), 3, 1)))
    (score,) = fresh(docs, "__score")
    return quality_mil.score(docs, model, out=score).filter(F.col(score) >= 0.5).select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_only(docs)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar by 0.8 or more, the one with the smallest id."""
    return simhash_wide.first_of_each(docs)


def repeated_text_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that start earlier, and without characters that lost some of theirs."""
    kept, kept_text, spans = fresh(docs, "__kept", "__text", "__spans")
    done = suffix_dedup.deduplicate(docs, kept=kept, kept_text=kept_text, spans=spans)
    done = done.withColumn("text", F.col(kept_text))
    return (done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done).select(docs.columns)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in windows of 2048."""
    pieces = packing.pack(docs, public_tokenizers.path(PACKED), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("simhash_near_dedup", near_duplicate_filter),
    ("suffix_array_dedup", repeated_text_removal),
    ("packing", window_packing),
]

#: SQL has no tokenizer and no trained model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, now = written(docs)
            if path:  # nothing reads the stage's input any more
                drop_table(spark, path)
            path = now
    return docs
