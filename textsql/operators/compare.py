"""Comparing runs.

All runs share one outcomes table keyed by (run, question_id); a comparison is a join of two
run slices on question_id (both sides hash-partitioned on the same key, one shuffle each), and
every count is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import error_category
from ..session import maybe_broadcast
from .evaluate import last_wins, percent_text


def _slice(outcomes: DataFrame, run: str, order_col: str | None) -> DataFrame:
    return last_wins(outcomes.filter(F.col("run") == run).drop("run"), "question_id", order_col)


def disagreements(outcomes: DataFrame, losing: str, winning: str, questions: DataFrame | None = None,
                  order_col: str | None = None, whitespace_tolerant: bool = False) -> DataFrame:
    """J4 + F7 + J5 + P19: questions the losing run gets wrong and the winning run gets right.

    Of a question's repeated rows the last counts (T13), by ``order_col``, else in reading order. NULL
    exec_match is wrong. Question text comes from ``questions`` (question_id, question), '' when absent.
    """
    a = _slice(outcomes, losing, order_col).filter(~F.coalesce(F.col("exec_match"), F.lit(False)))
    b = _slice(outcomes, winning, order_col).filter(F.coalesce(F.col("exec_match"), F.lit(False)))
    j = a.alias("a").join(b.alias("b"), on="question_id")
    out = j.select(
        "question_id",
        F.col("a.db_id").alias("db_id"),
        F.coalesce(F.col("a.difficulty"), F.lit("unknown")).alias("difficulty"),
        F.col("a.gold_sql").alias("gold_sql"),
        F.col("a.pred_sql").alias("pred_a_sql"),
        F.coalesce(F.col("a.failure_mode"), F.lit("")).alias("pred_a_failure"),
        F.col("b.pred_sql").alias("pred_b_sql"),
        error_category(F.col("a.gold_sql"), F.col("a.pred_sql"), F.coalesce(F.col("a.failure_mode"), F.lit("")),
                       whitespace_tolerant=whitespace_tolerant).alias("category"),
    )
    if questions is not None:
        out = out.join(questions.select("question_id", "question"), on="question_id", how="left")
    else:
        out = out.withColumn("question", F.lit(None).cast("string"))
    return out.withColumn("question", F.coalesce(F.col("question"), F.lit("")))


def category_counts(cases: DataFrame) -> DataFrame:
    """Cases per category, most common first (ties: the category seen first)."""
    g = cases.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("question_id").alias("first_question_id"))
    return g.orderBy(F.col("n").desc(), "first_question_id")


def case_examples(cases: DataFrame, n_examples: int = 12) -> DataFrame:
    """The first case of each category as its example, categories by size, at most N.

    ``min_by`` picks the first case per category as a partial aggregate; the category table
    has at most 12 rows, so the final ranking window is bounded."""
    per = cases.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("question_id", "db_id", "difficulty", "question", "gold_sql", "pred_a_sql",
                          "pred_a_failure", "pred_b_sql"), F.col("question_id")).alias("ex"),
    )
    w = Window.orderBy(F.col("n").desc(), F.col("ex.question_id"))
    ranked = per.withColumn("shown", F.row_number().over(w).cast("bigint")).filter(F.col("shown") <= n_examples)
    return ranked.select("shown", "category", "n", "ex.*")


def fixed_regressed(outcomes: DataFrame, baseline: str, treatments: Sequence[str] | None = None,
                    order_col: str | None = None) -> DataFrame:
    """Per treatment, questions it fixed (baseline wrong, treatment right), regressed (the
    reverse) and net. One join of the baseline slice against all treatment rows."""
    base = _slice(outcomes, baseline, order_col).select(
        "question_id", F.coalesce(F.col("exec_match"), F.lit(False)).alias("base_ok"))
    t = outcomes.filter(F.col("run") != baseline)
    if treatments is not None:
        t = t.filter(F.col("run").isin(list(treatments)))
    t = last_wins(t, ["run", "question_id"], order_col)
    j = t.join(base, on="question_id").withColumn("t_ok", F.coalesce(F.col("exec_match"), F.lit(False)))
    out = j.groupBy(F.col("run").alias("treatment")).agg(
        F.count_if(~F.col("base_ok") & F.col("t_ok")).alias("fixed"),
        F.count_if(F.col("base_ok") & ~F.col("t_ok")).alias("regressed"),
    ).withColumn("net", F.col("fixed") - F.col("regressed"))
    if treatments is None:
        return out
    # Listed treatments without outcomes (or a missing baseline) are flagged, not dropped.
    names = out.sparkSession.createDataFrame([(t,) for t in treatments], "treatment string")
    return names.join(out.withColumn("missing", F.lit(False)), "treatment", "left").withColumn(
        "missing", F.coalesce(F.col("missing"), F.lit(True)))


def change_categories(outcomes: DataFrame, baseline: str, treatments: Sequence[str] | None = None,
                      order_col: str | None = None) -> DataFrame:
    """G13, category counts both ways: (treatment, direction, category, n, first_question_id). ``fixed`` cases
    are sorted by what the baseline did wrong, ``regressed`` ones by what the treatment did. One join of the
    baseline slice against all treatment rows serves every treatment and both directions."""
    cols = ["question_id", "gold_sql", "pred_sql", F.coalesce("failure_mode", F.lit("")).alias("failure"),
            F.coalesce("exec_match", F.lit(False)).alias("ok")]
    base = _slice(outcomes, baseline, order_col).select(*cols)
    t = outcomes.filter(F.col("run") != baseline)
    if treatments is not None:
        t = t.filter(F.col("run").isin(list(treatments)))
    t = last_wins(t, ["run", "question_id"], order_col).select("run", *cols)
    j = t.alias("t").join(base.alias("b"), F.col("t.question_id") == F.col("b.question_id")).where(F.col("t.ok") != F.col("b.ok"))
    losing = lambda c: F.when(F.col("t.ok"), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}"))
    cases = j.select(F.col("run").alias("treatment"), F.when(F.col("t.ok"), "fixed").otherwise("regressed").alias("direction"),
                     F.col("t.question_id").alias("question_id"),
                     error_category(losing("gold_sql"), losing("pred_sql"), losing("failure")).alias("category"))
    return cases.groupBy("treatment", "direction", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("question_id").alias("first_question_id"))


def merge_runs(existing: DataFrame, new: DataFrame, key: str | Sequence[str] = "run") -> DataFrame:
    """Upsert -- a run present in ``new`` replaces all of its existing rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return existing.join(new.select(*keys).distinct(), on=keys, how="left_anti").unionByName(new)


def scaling_axis(axis: DataFrame, summary: DataFrame, run_col: str = "run") -> DataFrame:
    """J12 + P24: (label, run, size) left-joined to run-level accuracy; 'NaN' for a missing run.

    The axis is a hand-written list of a few points; it is broadcast after a count confirms it."""
    overall = summary.filter(F.col("difficulty") == "all").select(run_col, "exec_accuracy")
    j = maybe_broadcast(axis, max_rows=10_000).join(overall, on=run_col, how="left")
    return j.withColumn("exec_pct", percent_text(F.col("exec_accuracy")))


def anchor_run(runs: DataFrame, pattern: str, run_col: str = "run") -> DataFrame:
    """The first run (by name) whose name matches ``pattern``; empty when none does."""
    return runs.filter(F.col(run_col).rlike(pattern)).agg(F.min(run_col).alias(run_col)).filter(
        F.col(run_col).isNotNull())


def results_document(summary: DataFrame, run_col: str = "run") -> DataFrame:
    """One JSON document per run (summary with per-difficulty map) -- the write side of the
    comparison file; ``to_json`` of a struct per run."""
    per_diff = summary.filter(F.col("difficulty") != "all").groupBy(run_col).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "difficulty", F.struct(F.col("n").cast("double").alias("n"), "exec_accuracy", "exact_match_accuracy"))))
        .alias("by_difficulty"))
    overall = summary.filter(F.col("difficulty") == "all").select(run_col, "n", "exec_accuracy", "exact_match_accuracy")
    doc = overall.join(per_diff, on=run_col, how="left")
    return doc.select(run_col, F.to_json(F.struct("n", "exec_accuracy", "exact_match_accuracy", "by_difficulty"))
                      .alias("summary_json"))
