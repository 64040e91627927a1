"""End-to-end jobs composed from the operators.

``evaluate_runs`` -- every run's predictions in one long table: J1 join to examples, one X1
over all distinct (database, statement), one X2, outcome columns, one GROUPING SETS roll-up.

``generate_traces`` -- responses (already stored, J9) -> extracted SQL (P10/P11) -> one X1 over
gold and candidate statements -> X2 against gold -> W1 choice with drop reasons -> traces
(A5 shape), funnel (G4) and drop-reason histogram (G5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import extract_sql, split_reasoning
from ..functions.sqltext import difficulty, exact_match
from ..functions.text import clean_sql
from ..operators import evaluate as ev
from ..operators.execute import score_pairs
from ..operators.traces import build_traces, candidate_funnel, drop_reasons, select_candidates


def evaluate_runs(spark: SparkSession, examples: DataFrame, predictions: DataFrame,
                  db_col: str | None = "db_id", tables_for=None, **run_kw) -> tuple[DataFrame, DataFrame]:
    """X4 for many runs at once.

    examples: (question_id, db_id, question, query); predictions: (run, question_id,
    predicted_sql). Returns (outcomes, summary); outcomes carry the cleaned prediction as
    ``pred_sql`` (the raw one goes to ``write_outcomes``).
    """
    j = ev.join_predictions(predictions.drop("db_id") if "db_id" in predictions.columns else predictions,
                            examples).withColumnRenamed("ex_db_id", "db_id")
    pairs = j.select(
        F.concat_ws(":", F.col("run"), F.col("question_id").cast("string")).alias("pair_id"),
        "run", "question_id", "db_id", "gold_sql",
        F.coalesce(clean_sql("predicted_sql"), F.lit("")).alias("pred_sql"),
    )
    scored = score_pairs(spark, pairs.select("pair_id", "db_id", "gold_sql", "pred_sql"),
                         db_col=db_col if db_col else None, tables_for=tables_for, **run_kw)
    outcomes = pairs.join(scored, "pair_id").select(
        "run", "question_id", "db_id",
        difficulty("gold_sql").alias("difficulty"),
        "gold_sql", "pred_sql", "exec_match",
        exact_match("pred_sql", "gold_sql").alias("exact_set_match"),
        "failure_mode",
    )
    return outcomes, ev.summarize(outcomes)


def generate_traces(spark: SparkSession, examples: DataFrame, responses: DataFrame, modes: DataFrame,
                    schema_tables: DataFrame, db_col: str = "db_id", tables_for=None,
                    **select_kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trace generation over stored responses.

    examples: (question_id, db_id, question, query); responses: (question_id, sample_index,
    text); modes: (question_id, mode); schema_tables: (db_id, tables array<string>).
    Returns (traces, funnel, drop_reasons).
    """
    cand = responses.select(
        "question_id", "sample_index",
        split_reasoning("text").alias("reasoning"), extract_sql("text").alias("sql"),
    ).join(examples.select("question_id", "db_id", F.col("query").alias("gold_sql")), "question_id")
    pairs = cand.select(
        F.concat_ws(":", F.col("question_id").cast("string"), F.col("sample_index").cast("string")).alias("pair_id"),
        "db_id", "gold_sql", F.coalesce("sql", F.lit("")).alias("pred_sql"),
    )
    # Gold statements run too (their status decides gold-failed) -- once per (db, statement).
    gold_pairs = examples.select(F.concat(F.lit("gold:"), F.col("question_id").cast("string")).alias("pair_id"),
                                 "db_id", F.col("query").alias("gold_sql"), F.col("query").alias("pred_sql"))
    scored = score_pairs(spark, pairs.unionByName(gold_pairs), db_col=db_col, tables_for=tables_for)
    gold_ok = scored.filter(F.col("pair_id").startswith("gold:")).select(
        F.substring_index("pair_id", ":", -1).cast("bigint").alias("question_id"),
        (F.col("gold_status") == "ok").alias("gold_ok"))
    cs = cand.withColumn("pair_id", F.concat_ws(":", F.col("question_id").cast("string"),
                                                F.col("sample_index").cast("string"))).join(scored, "pair_id")
    candidates = cs.select(
        "question_id", "sample_index", "sql", "reasoning",
        (F.col("sql").isNotNull() & ~F.col("pred_status").isin("parse", "empty")).alias("parses_ok"),
        (F.col("pred_status") == "ok").alias("executes_ok"),
        F.col("exec_match").alias("matches_gold"),
    )
    questions = examples.select("question_id", "db_id").join(gold_ok, "question_id", "left").join(
        schema_tables.select("db_id", F.lit(True).alias("has_schema")), "db_id", "left")
    selection = select_candidates(questions, candidates, schema_tables, **select_kw)
    chosen_reasoning = candidates.select("question_id", F.col("sample_index").alias("chosen_index"), "reasoning")
    reasoning = selection.join(chosen_reasoning, ["question_id", "chosen_index"]).select("question_id", "reasoning")
    traces = build_traces(selection, examples, modes, reasoning=reasoning)
    return traces, candidate_funnel(selection, candidates), drop_reasons(selection)
