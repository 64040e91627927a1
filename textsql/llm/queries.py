"""Queries and SQL of the thirteen operators (registered by ``__spark_entry__.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsql.session import scratch_path

from . import chat, embeddings, licenses, minhash, mixing, negatives, packing, pii, quality, runs, substrings, toxicity, warc
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.template_table(spark))


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).drop("url", "payload")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).select(*quality.COLUMNS)


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_passages(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_spans(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("sentences")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved).drop("positive_rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.fold_texts(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_superminhash, op3_multi_index, op4_warc, op5_quality_rules, op6_passage_dedup, op6_line_dedup, op7_chat_format,
    op8_pii_boosting, op9_soft_mixing, op10_packing, op11_toxicity_mil, op12_hard_negatives, op13_periodic_runs)}
ORACLE = {"op2_superminhash": minhash.ORACLE, "op3_multi_index": embeddings.ORACLE, "op4_warc": warc.ORACLE,
          "op5_quality_rules": quality.ORACLE, "op6_line_dedup": substrings.ORACLE, "op12_hard_negatives": negatives.ORACLE}
