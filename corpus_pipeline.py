"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotable.llm.common import cut
from geotable.llm.decontamination import contaminated
from geotable.llm.minhash import near_duplicates, only
from geotable.llm.packing import pack
from geotable.llm.secrets import redacted
from geotable.llm.toxicity import scored, trained
from geotable.operators.storage import mark, sweep

#: A document at this toxicity or more is rejected.
TOXIC = 0.3

#: No SQL expresses a trained model or a packing plan; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labels outside the held-out quarter, doesn't reject."""
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    rated = scored(docs.withColumn("__rated", F.col("text")), model, text="__rated")
    return rated.where(F.col("score") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates (five words, similarity 0.8)."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return only(docs, "doc_id", found.where(~F.col("kept")).select("doc_id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    hits = contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return only(docs, "doc_id", cut(hits.select("doc_id")), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced, and n_chars as the text now is."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("dedup", dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        sweep(spark, since, docs)  # what the stage itself had to write
    return STAGES[-1][1](spark, docs, sf_dir)
