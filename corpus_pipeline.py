"""The corpus pipeline: quality rules, near-dedup, PII, mixing, packing, each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textsql.llm import minhash, mixing, packing, pii, quality
from textsql.llm.common import materialise, table


# The first stage rejects documents of low quality, so that domain has no target here: the others keep their
# proportion, and no document is repeated more than MAX_RATE times.
TARGETS_LEFT = tuple(None if d == "low" else t / (1 - mixing.TARGETS[mixing.DOMAINS.index("low")])
                     for d, t in zip(mixing.DOMAINS, mixing.TARGETS))
MAX_RATE = 8.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"), targets=TARGETS_LEFT, max_rate=MAX_RATE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("pii", pii_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# Tokenising, boosted trees and the classifier have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
