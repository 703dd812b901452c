"""A training corpus from `documents`: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes
every stage as Parquet in the cluster's shared folder and reads it back. All stages but the last
return the columns of `documents`, further columns included.

Results: null and empty texts score 0 and go in the first stage, and so no later stage of run()
meets them; alone, the others keep them (they are near to nothing and have no sentences). Equal
rows, and rows near to each other, leave one row: of the smallest doc_id, then of the smallest hash
of the text. Rows without doc_id are scored and packed, but nothing is removed from them as a copy.
An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import near_dedup, packing, quality, sentence_dedup
from codelode.runtime import remove, shared_dir, ship, table


def _own(docs: DataFrame) -> str:
    """A prefix that no column of docs has."""
    return "_" * (1 + max(map(len, docs.columns)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own = _own(docs)
    return quality.classify(docs, model, prefix=own).where(own + "quality_kept").select(docs.columns)


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return near_dedup.distinct(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that an earlier document, or an earlier place, has too."""
    ship(spark)
    left = sentence_dedup.dedup(docs, prefix=_own(docs))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 tokens."""
    ship(spark)
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("near-dedup", near_distinct), ("substring dedup", distinct_passages), ("best-fit packing", packed)]
#: Quality votes, sketches and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
