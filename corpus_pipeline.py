"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor kept. All
but the last return the columns of ``documents``; ``run`` writes each stage's result to the
shared folder and reads it back as the next one's documents.

Defined results, for every stage: null or empty texts are documents like others, which no stage
but line dedup changes (null becomes empty there) and none drops; rows of one ``doc_id`` go or
stay together; columns beyond those of ``documents`` are left out; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, line_dedup, minhash_dedup, packing, toxicity
from weftline.llm.shared import drop_staged, staged

#: Words that a packing worker keeps: executors have grown by the stages before, so a quarter of what packing alone keeps.
PACKING_WORDS = 250_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the documents given here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels)).select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (Jaccard 0.8 or more)."""
    gone = minhash_dedup.near_duplicates(docs, 80).where(~F.col("kept"))
    return _without(docs, gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither as it is nor re-parameterised."""
    return _without(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), words=PACKING_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are not SQL; tests hold line dedup, near-duplicates and packing to brute force,
#: and toxicity and decontamination to labels and benchmark texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
