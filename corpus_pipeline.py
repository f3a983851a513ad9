"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality     documents that the classifier rejects go
near_dedup  one document of each class of near-duplicates stays
secrets     secrets in texts are masked; no document goes
mix         documents of each source are repeated or left out to meet the target weights
pack        documents are placed in training sequences; the result has a row per placed piece

All stages but the last return the columns of documents. ``run`` returns the last stage's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderlog.llm import bagminhash, mixing, packing, quality, secrets
from cinderlog.llm.stages import drop, stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.first_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mix", mix_stage), ("pack", pack_stage)]
#: SQL has no trained classifier, signature or forest; tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        out = stage(step(spark, docs, sf_dir))
        drop(docs)
        docs = out
    return docs
