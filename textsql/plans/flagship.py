"""Flagship plan: result-set scoring rolled up by difficulty (X2 -> outcomes -> G1/G2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.resultset import multiset_equal
from . import views as V


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a question whose gold result is its line items; the prediction's rows are
    the perturbed copy. Exec match by multiset comparison, then accuracy per difficulty."""
    match = multiset_equal(V.gold_rows(spark, sf_dir), V.pred_rows(spark, sf_dir), key="question_id")
    o = V.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("question_id"),
        F.substring("o_orderpriority", 1, 1).alias("p"),
    )
    diff = (F.when(F.col("p") == "1", "easy").when(F.col("p") == "2", "medium").when(F.col("p") == "3", "hard")
            .when(F.col("p") == "4", "extra").otherwise("unknown"))
    outcomes = o.join(match, on="question_id", how="inner").select(
        F.lit("replay").alias("run"), "question_id", diff.alias("difficulty"), "exec_match",
        F.col("exec_match").alias("exact_set_match"),
    )
    return ev.summarize(outcomes)
