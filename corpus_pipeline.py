"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written and read again
before the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import best_fit_packing, decontamination, ngram_jaccard, suffix_dedup, toxicity
from tidemark.llm.common import cut, identified, passing, restored, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose worst word or run scores as toxic go; null and empty texts stay, repeated rows stay or go alike."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word runs at a Jaccard similarity of 0.8 the row of the smallest doc_id stays, once.

    Of rows that share a doc_id the least by all values stays. Rows without a doc_id take part: equal ones are one
    document, and give way to documents with an id. Null and empty texts are near to nothing, and stay.
    """
    rows, lacks = identified(docs)
    with passing(spark):
        groups = ngram_jaccard.join(rows, n=5, percent=80)
        copies = cut(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates", keep=True)
    kept = without(rows, copies)
    again = cut(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if not again.isEmpty():
        once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*kept.columns)).alias("row")).select("row.*")
        kept = without(kept, again).unionByName(once)
    return restored(kept, lacks)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each passage of 50 words or more that repeats, the first occurrence stays; n_chars follows the text.

    Texts of which nothing is left go; null, empty and shorter ones stay. Rows without a doc_id take part.
    """
    rows, lacks = identified(docs)
    trimmed = suffix_dedup.remove_repeats(rows, length=50).withColumn("n_chars", F.length("text").cast("long"))
    return restored(trimmed, lacks).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, with or without a doc_id; null and empty texts stay."""
    rows, lacks = identified(docs)
    return restored(decontamination.clean(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), lacks)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed into sequences of 2048 tokens: a row per piece; a null text is the end id alone."""
    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("benchmark leaks", drop_benchmark_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
