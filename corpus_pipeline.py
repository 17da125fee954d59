"""A corpus pipeline: each stage is one operator, takes (spark, docs, sf_dir), and works on all that the last one kept.

All stages but the last return the columns of their input, whatever their names.  Null texts count as empty; texts are read
whole, whatever their length; an empty table stays empty.  Rows that share a doc_id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hornlake.llm import common, exact_dedup, near_dedup, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is 0.5 or more go; the model learns from the labels of the input's documents.

    Without labels of both kinds the score is their share, 0 without any.  Repeated rows and rows without doc_id are scored
    like others; null texts are scored as texts without words and stay null.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each class of texts that are equal without white space.

    It is the one with the most code points, then with the smallest doc_id; a row without doc_id only where its class has
    no other.  Null, empty and white texts are one class; of repeated rows one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, stays of each component of texts whose five-word shingles agree to 0.8.

    Texts without words and rows without doc_id link with nothing and stay; of repeated rows one stays.
    """
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows and null texts too; each secret in a text becomes a mark."""
    return secrets.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of at most 1024 tokens; an empty text is its end id alone."""
    return packing.pack_documents(docs, room=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained trees, MinHash and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, writing each result as Parquet and reading it again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = common.stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
