"""A corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, personal data, tokens.

Each stage takes what its predecessor kept, with the columns of documents, and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillspark.llm import decontaminate, langid, pii, sentencepiece_fst, simhash
from skillspark.llm.common import discard, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without text or without a letter go. A missing lang is filled in.

    Where no document has a lang nothing can be learned or rejected, and all stay. Repeated rows each stay; an empty table stays empty.
    """
    if docs.where("lang is not null and text is not null").isEmpty():
        return docs
    found = langid.identify(docs, keep=tuple(c for c in docs.columns if c != "doc_id")).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, and of repeated rows one; those without id or text stay."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those without id or text stay, and so do repeated ones. Without a benchmark all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with personal data and terms that reveal it replaced; n_chars is that of the new text, null for a null text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, with the hash of what they decode to and whether that is the text; all three null for a null text."""
    rows = sentencepiece_fst.round_trip(docs)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "whole")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: Stages 1, 2, 4 and 5 learn a model, hash, or walk an automaton, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = f"{place}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if i:  # what the stage has read
            discard(spark, f"{place}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
