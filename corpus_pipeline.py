"""A training-data pipeline over ``documents``: toxic documents and near copies go, sources are mixed, texts encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``. ``ORACLE_SQL`` is None: SQL can't express the factorisation machine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, mixing, neardup, toxicity
from quillspark.llm._frames import written

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the threshold stay. Null and empty texts score by the bias alone; repeated rows alike; without labels all stay; an empty table stays empty."""
    machine = toxicity.train_machine(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays. Null and empty texts and rows without an id stay; of rows equal in id and text one; an empty table stays empty."""
    return neardup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. Null ids and sources take part; texts without words too; equal rows at a border as the budget holds; an empty table stays empty."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row as digests. A null text is empty; null ids stay null; repeated rows give repeated results; an empty table stays empty."""
    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("near duplicates", drop_copies), ("mixing", mix), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # the next stage reads what this one has written
            docs = written(docs, f"stage{k}")
    return docs
