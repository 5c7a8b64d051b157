"""Corpus pipeline: quality rules, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs; all but the last give the columns of documents.
Extra columns pass through, whatever their names, up to the last. Rows without an id are kept as the stages say, repeated
rows are judged alike and one of them stays; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.llm import jaccard, packing, quality, suffixes
from weightloom.llm.common import documents, work_dir


#: Where the vocabulary lies.
WORDS = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go from those that stay. Null and empty texts are rejected."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays. Linked are texts whose five-word shingles have a Jaccard similarity of 0.8.

    A row without an id stays if its group has no id at all, one for each group.
    """
    return jaccard.representatives(docs, similarity=0.8, shingle=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that a document with a smaller id holds go; documents stay."""
    return suffixes.clean(docs, length=200).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; each text, null and empty ones too, has a piece, and repeated rows one each."""
    return packing.pack_texts(docs, WORDS)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeated_passages", repeated_passages), ("packed", packed)]
#: SQL can't express shingles hashed by XXH64 or a tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
