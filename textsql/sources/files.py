"""Row sinks and their read-backs (A4-A7, A9, A11): JSON lines / parquet with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import read_jsonl
from ..schemas import OUTCOME, TRACE


def write_outcomes(outcomes: DataFrame, predictions: DataFrame, path: str, run_col: str = "run") -> None:
    """Per-example outcomes; the SQL column is the *raw* prediction (not the cleaned one).
    Partitioned by run so later reads prune to the runs they compare."""
    raw = predictions.select(run_col, "question_id", F.col("predicted_sql").alias("__raw"))
    out = outcomes.join(raw, on=[run_col, "question_id"], how="left").withColumn(
        "pred_sql", F.coalesce(F.col("__raw"), F.col("pred_sql"))).drop("__raw")
    out.select(run_col, *[f.name for f in OUTCOME.fields]).write.mode("overwrite").partitionBy(run_col).json(path)


def read_outcomes(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """A4 for outcomes: explicit schema; a ``runs`` filter prunes partitions."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*OUTCOME.fields, StructField("run", StringType())])
    df = spark.read.schema(schema).json(path)
    return df.filter(F.col("run").isin(runs)) if runs else df


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A4 for traces (malformed lines quarantined in ``_corrupt_record``)."""
    return read_jsonl(spark, path, TRACE)


def read_predictions_jsonl(spark: SparkSession, path: str, none_as_text: bool = True) -> DataFrame:
    """A4 for an offline prediction file, with the offline scorer's value rules (T14): a present
    but null ``predicted_sql`` reads as the text ``'None'`` (``none_as_text``), a missing key as
    ``''``; blank lines are skipped; ``question_id`` and ``db_id`` are required."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.json_object_keys("value")
    sql = F.get_json_object("value", "$.predicted_sql")
    present = F.coalesce(F.array_contains(keys, "predicted_sql"), F.lit(False))
    qid = F.get_json_object("value", "$.question_id").cast("bigint")
    out = lines.select(
        F.when(qid.isNull(), F.raise_error(F.lit("prediction line without question_id"))).otherwise(qid)
        .alias("question_id"),
        F.get_json_object("value", "$.db_id").alias("db_id"),
        F.when(sql.isNotNull(), sql).when(present & F.lit(none_as_text), F.lit("None")).otherwise(F.lit(""))
        .alias("predicted_sql"),
    )
    return out
