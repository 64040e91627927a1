"""Explicit schemas of the pipeline's entities and value checks.

Every reader uses one of these ``StructType`` s (never inference). Value checks are boolean
expectation columns: rows failing any check are split off into a quarantine DataFrame instead
of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])

PREDICTION = StructType([
    StructField("question_id", LongType()), StructField("db_id", StringType()),
    StructField("predicted_sql", StringType()),
])

OUTCOME = StructType([
    StructField("question_id", LongType()), StructField("db_id", StringType()),
    StructField("difficulty", StringType()), StructField("gold_sql", StringType()),
    StructField("pred_sql", StringType()), StructField("exec_match", BooleanType()),
    StructField("exact_set_match", BooleanType()), StructField("failure_mode", StringType()),
])

TRACE = StructType([
    StructField("question_id", LongType()), StructField("db_id", StringType()),
    StructField("question", StringType()), StructField("schema_block", StringType()),
    StructField("mode", StringType()), StructField("sql", StringType()),
    StructField("reasoning", StringType()), StructField("gold_sql", StringType()),
    StructField("n_candidates", LongType()), StructField("matched_gold", BooleanType()),
])

CANDIDATE = StructType([
    StructField("question_id", LongType()), StructField("sample_index", LongType()),
    StructField("raw_text", StringType()), StructField("sql", StringType()),
    StructField("reasoning", StringType()), StructField("parses_ok", BooleanType()),
    StructField("executes_ok", BooleanType()), StructField("matches_gold", BooleanType()),
])

RESPONSE = StructType([
    StructField("key", StringType()), StructField("text", StringType()),
    StructField("prompt_tokens", LongType()), StructField("completion_tokens", LongType()),
    StructField("finish_reason", StringType()), StructField("model", StringType()),
    StructField("saved_at", DoubleType()),
])

REQUEST = StructType([
    StructField("model", StringType()), StructField("messages", ArrayType(MESSAGE)),
    StructField("temperature", DoubleType()), StructField("max_tokens", LongType()),
    StructField("sample_index", LongType()),
])

# --- fixed values -----------------------------------------------------------------------------
RUN_NAME_RE = r"^[A-Za-z0-9_-]+$"
MODES = ("direct", "reasoning")
PREDICTOR_KINDS = ("base", "lora", "openai")
# ----------------------------------------------------------------------------------------------


def checks(run_col: str | None = "run", share_col: str | None = None, kind_col: str | None = None,
           mode_col: str | None = None) -> dict[str, Column]:
    """P26 expectations as named boolean columns (NULL counts as failing)."""
    out: dict[str, Column] = {}
    if run_col:
        out["run_name_ok"] = F.coalesce(F.col(run_col).rlike(RUN_NAME_RE), F.lit(False))
    if share_col:
        out["share_ok"] = F.coalesce(F.col(share_col).between(0.0, 1.0), F.lit(False))
    if kind_col:
        out["kind_ok"] = F.coalesce(F.col(kind_col).isin(*PREDICTOR_KINDS), F.lit(False))
    if mode_col:
        out["mode_ok"] = F.coalesce(F.col(mode_col).isin(*MODES), F.lit(False))
    return out


def split_valid(df: DataFrame, expectations: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the list of failed checks)."""
    failed = F.filter(F.array(*[F.when(~c, F.lit(n)) for n, c in expectations.items()]), lambda x: x.isNotNull())
    tagged = df.withColumn("__failed", failed)
    valid = tagged.filter(F.size("__failed") == 0).drop("__failed")
    bad = tagged.filter(F.size("__failed") > 0).withColumnRenamed("__failed", "failed_checks")
    return valid, bad
