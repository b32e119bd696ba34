"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

toxicity       documents that score 0.5 or more are dropped
near_dedup     of each component of near copies (5-word shingles, 0.8) the least doc_id stays
decontaminate  documents with benchmark passages are dropped
secrets        secrets in texts are replaced by a mask
packing        what is left becomes sequences of 4096 tokens; one row a piece

All stages but the last return the columns they are given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate as seeds
from lodestar.llm import secrets as secret_tags
from lodestar.llm import toxicity as toxic_tags
from lodestar.llm.common import table
from lodestar.llm.minhash import near_duplicates
from lodestar.llm.packing import pack_documents
from lodestar.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_tags.remove_toxic(docs, toxic_tags.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return seeds.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_tags.redact(docs, secret_tags.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: The models, the sketches and the tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder the cluster names in spark.checkpoint.dir."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
