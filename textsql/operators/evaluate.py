"""Scoring predictions (X4) and rolling them up.

All runs live in one long table keyed by ``(run, question_id)``: one pass over the outcomes
serves every run, and every roll-up is a partial (map-side combined) aggregate, so the shuffle
carries one row per (task, group) rather than one per outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import (
    DIFFICULTY_BUCKETS,
    FAILURE_MODES,
    classify_failure,
    difficulty,
    exact_match,
)


# --- fixed values -----------------------------------------------------------------------------
# The external evaluator's printout: a line per metric, a figure per bucket.
EVAL_LINE_RE = (
    r"^\s*(execution|exact match)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)\s*$"
)
EVAL_BUCKETS = ("easy", "medium", "hard", "extra", "all")
# ----------------------------------------------------------------------------------------------


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


# ----------------------------------------------------------------------------------------------
# Per-example outcome columns
# ----------------------------------------------------------------------------------------------

def with_outcome(df: DataFrame, gold_col: str = "gold_sql", pred_col: str = "pred_sql",
                 parses_col: str = "parses", executes_col: str = "executes",
                 match_col: str = "exec_match") -> DataFrame:
    """Adds difficulty (P16), exact_set_match (P17) and failure_mode."""
    return df.withColumns({
        "difficulty": difficulty(gold_col),
        "exact_set_match": exact_match(pred_col, gold_col),
        "failure_mode": classify_failure(pred_col, parses_col, executes_col, match_col),
    })


# ----------------------------------------------------------------------------------------------
# Roll-ups
# ----------------------------------------------------------------------------------------------

def summarize(outcomes: DataFrame, run_col: str = "run", ndigits: int = 6,
              runs: DataFrame | None = None) -> DataFrame:
    """G1 + G2 in one pass: ``GROUPING SETS ((run), (run, difficulty))``.

    Output: run, difficulty (``'all'`` on the per-run row), n, exec_accuracy,
    exact_match_accuracy. With ``runs`` (a list of run names), a run without any outcome still
    gets its ``'all'`` row with n = 0 and accuracies 0.0 (empty input gives zeros, not NULL).
    """
    n = F.count(F.lit(1))
    g = outcomes.groupingSets([[run_col], [run_col, "difficulty"]], run_col, "difficulty").agg(
        n.alias("n"),
        F.sum(F.col("exec_match").cast("int")).alias("_ne"),
        F.sum(F.col("exact_set_match").cast("int")).alias("_nx"),
        F.grouping("difficulty").alias("_gd"),
    )
    out = g.select(
        run_col,
        F.when(F.col("_gd") == 1, F.lit("all")).otherwise(F.col("difficulty")).alias("difficulty"),
        F.col("n").cast("bigint").alias("n"),
        F.round(_ratio(F.col("_ne"), F.col("n")), ndigits).alias("exec_accuracy"),
        F.round(_ratio(F.col("_nx"), F.col("n")), ndigits).alias("exact_match_accuracy"),
    )
    if runs is None:
        return out
    empty = runs.select(run_col).distinct().join(out.select(run_col).distinct(), run_col, "left_anti").select(
        run_col, F.lit("all").alias("difficulty"), F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("exec_accuracy"), F.lit(0.0).alias("exact_match_accuracy"))
    return out.unionByName(empty)


def failure_breakdown(outcomes: DataFrame, run_col: str = "run", ndigits: int = 4,
                      runs: DataFrame | None = None) -> DataFrame:
    """Counts of the five failure modes per run (0 when absent) plus their shares. With
    ``runs`` every listed run appears; one without outcomes is flagged ``missing``."""
    aggs = [F.count_if(F.col("failure_mode") == m).alias(m.replace("-", "_")) for m in FAILURE_MODES]
    counted = outcomes.groupBy(run_col).agg(F.count(F.lit(1)).alias("total"), *aggs)
    shares = [
        F.round(_ratio(100.0 * F.col(m.replace("-", "_")), F.col("total")), ndigits).alias(
            "pct_" + m.replace("-", "_"))
        for m in FAILURE_MODES
    ]
    out = counted.select("*", *shares)
    if runs is None:
        return out
    full = runs.select(run_col).distinct().join(out.withColumn("missing", F.lit(False)), run_col, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["total", *[m.replace("-", "_") for m in FAILURE_MODES]]}
    zero.update({f"pct_{m.replace('-', '_')}": F.coalesce(F.col(f"pct_{m.replace('-', '_')}"), F.lit(0.0))
                 for m in FAILURE_MODES})
    return full.withColumns(zero).withColumn("missing", F.coalesce(F.col("missing"), F.lit(True)))


def leaderboard(outcomes: DataFrame, run_col: str = "run", labels: DataFrame | None = None,
                ndigits: int = 6) -> DataFrame:
    """G12 (+ P25 labels): one row per run with overall and per-bucket execution accuracy.

    A missing bucket reads 0.0, and a NULL match counts as wrong, as in G1. ``labels`` (run, label) is a small display table; missing
    labels fall back to the run name. Order: ascending by exec_accuracy, then run (W10).
    """
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"),
        F.round(_ratio(F.count_if("exec_match"), n), ndigits).alias("exec_accuracy"),
        F.round(_ratio(F.count_if("exact_set_match"), n), ndigits).alias("exact_match_accuracy"),
    ]
    for b in DIFFICULTY_BUCKETS:
        hit = F.count_if((F.col("difficulty") == b) & F.col("exec_match"))
        tot = F.count_if(F.col("difficulty") == b)
        aggs.append(F.round(_ratio(hit.cast("double"), tot), ndigits).alias(b))
    board = outcomes.groupBy(run_col).agg(*aggs)
    if labels is not None:
        # Display labels are a hand-written list (tens of rows); broadcast once a count confirms.
        from ..session import maybe_broadcast

        board = board.join(maybe_broadcast(labels, max_rows=10_000), on=run_col, how="left")
        board = board.withColumn("label", F.coalesce(F.col("label"), F.col(run_col)))
    else:
        board = board.withColumn("label", F.col(run_col))
    return board.orderBy("exec_accuracy", run_col)


def percent_board(board: DataFrame) -> DataFrame:
    """G12, percent variant: label and the accuracies as ``12.3%`` texts, without n and exact match, in
    the same order."""
    cells = [F.concat(percent_text(F.col(c)), F.lit("%")).alias(c) for c in ("exec_accuracy", *DIFFICULTY_BUCKETS)]
    return board.select("run", "label", F.col("exec_accuracy").alias("__acc"), *cells).orderBy("__acc", "run").drop("__acc")


def percent_text(x: Column, ndigits: int = 1) -> Column:
    """``100*x`` rounded half-even to ``ndigits`` and printed, or 'NaN' when missing."""
    return F.when(x.isNull(), F.lit("NaN")).otherwise(
        F.format_string(f"%.{ndigits}f", F.bround(x * 100.0, ndigits)))


# ----------------------------------------------------------------------------------------------
# Joins around prediction
# ----------------------------------------------------------------------------------------------

def last_wins(df: DataFrame, key: Sequence[str] | str, order_col: str | None) -> DataFrame:
    """Keep the row with the greatest ``order_col`` per key (dict-building semantics); without one, the
    last in reading order (files and their rows as they were split, so a shuffle before it leaves that open).

    ``max_by`` is a partial aggregate: no single task ever holds a whole key group.
    """
    key = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in key]
    if not others:
        return df.distinct()
    if order_col is None:
        df, order_col = df.withColumn("__at", F.monotonically_increasing_id()), "__at"
    packed = F.struct(*[F.col(c) for c in others])
    return (
        df.groupBy(*key)
        .agg(F.max_by(packed, F.col(order_col)).alias("__last"))
        .select(*key, *[F.col(f"__last.{c}").alias(c) for c in others])
    )


def join_predictions(predictions: DataFrame, examples: DataFrame, strict: bool = True) -> DataFrame:
    """Predictions joined to their example on question_id.

    An unknown or NULL question id fails the job (``raise_error``) when ``strict``; the check
    is a column in the same left join, so it costs no extra pass.
    """
    ex = examples.select(
        "question_id", F.col("db_id").alias("ex_db_id"), "question", F.col("query").alias("gold_sql"),
        F.lit(True).alias("__known"),
    )
    j = predictions.join(ex, on="question_id", how="left")
    if strict:
        # The check sits in a filter so the optimizer cannot prune it away.
        check = F.when(
            F.col("__known").isNull(),
            F.raise_error(F.concat(F.lit("no example for question_id "),
                                   F.coalesce(F.col("question_id").cast("string"), F.lit("NULL")))),
        ).otherwise(F.lit(True))
        return j.filter(check.isNull() | check).drop("__known")
    return j.filter(F.col("__known")).drop("__known")


def attach_outputs(examples: DataFrame, outputs: DataFrame, text_col: str = "predicted_sql") -> DataFrame:
    """Every example gets its model output; absent or NULL -> ''."""
    return examples.join(outputs.select("question_id", text_col), on="question_id", how="left").withColumn(
        text_col, F.coalesce(F.col(text_col), F.lit(""))
    )


def attach_schemas(examples: DataFrame, schemas: DataFrame, order_col: str | None = None) -> DataFrame:
    """Examples left-joined to their DB's schema; ``has_schema`` marks a miss. A database listed more
    than once counts by its last row (by ``order_col``, else in reading order), so no example is repeated.

    The schema catalog is one row per database (tens to thousands of rows, each a few KB);
    Spark/AQE broadcasts it when its measured size is under the broadcast threshold and falls
    back to a shuffle join otherwise, so no explicit hint is forced here.
    """
    s = last_wins(schemas, "db_id", order_col).withColumn("has_schema", F.lit(True))
    return examples.join(s, on="db_id", how="left").withColumn(
        "has_schema", F.coalesce(F.col("has_schema"), F.lit(False))
    )


# ----------------------------------------------------------------------------------------------
# Predictors
# ----------------------------------------------------------------------------------------------

def predict_gold(examples: DataFrame) -> DataFrame:
    """U1 baseline: the gold statement is the prediction."""
    return examples.select("question_id", "db_id", F.col("query").alias("predicted_sql"))


def predict_empty(examples: DataFrame) -> DataFrame:
    """U1 baseline: every prediction is empty."""
    return examples.select("question_id", "db_id", F.lit("").alias("predicted_sql"))


def predict_with(examples: DataFrame, fn: Callable, batch_cols: Sequence[str] = ("question_id", "db_id", "question")) -> DataFrame:
    """U1 hook: ``fn(pandas.DataFrame) -> pandas.Series[str]`` applied per Arrow batch.

    Runs through ``mapInPandas`` so a model (or any Python predictor) sees vectorised batches
    on the executors; nothing passes through the driver.
    """
    cols = list(batch_cols)

    def _run(batches):
        for pdf in batches:
            out = pdf[["question_id", "db_id"]].copy()
            out["predicted_sql"] = fn(pdf).astype(str).values
            yield out

    return examples.select(*cols).mapInPandas(_run, "question_id long, db_id string, predicted_sql string")


# ----------------------------------------------------------------------------------------------
# Evaluator files (A8) and printout (A14), external overlay
# ----------------------------------------------------------------------------------------------

def evaluator_pred_lines(predictions: DataFrame, order_col: str = "question_id") -> DataFrame:
    """A8 prediction file: newlines -> space, blank -> ``SELECT 1``; one line per example."""
    from ..functions.text import py_strip

    s = F.regexp_replace(F.coalesce(py_strip("predicted_sql"), F.lit("")), "[\n\r]", " ")
    return predictions.select(order_col, F.when(s == "", "SELECT 1").otherwise(s).alias("line"))


def evaluator_gold_lines(examples: DataFrame, order_col: str = "question_id") -> DataFrame:
    """A8 gold file: ``SQL<TAB>db_id``."""
    from ..functions.text import py_strip

    return examples.select(
        order_col,
        F.concat(F.replace(py_strip("query"), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.col("db_id")).alias("line"),
    )


def write_evaluator_files(rows: DataFrame, path: str, rows_per_file: int = 1_000_000) -> int:
    """A8 both files, line n of one belonging to line n of the other: committed parts in ``question_id`` order
    (``sources.lines``). ``rows`` has question_id, db_id, predicted_sql and query; a null query or db_id is empty."""
    from ..sources.lines import write_aligned

    both = rows.select("question_id", F.coalesce("db_id", F.lit("")).alias("db_id"), "predicted_sql",
                       F.coalesce("query", F.lit("")).alias("query"))
    lines = evaluator_pred_lines(both.withColumn("__l", F.struct("question_id", "db_id", "query")), "__l")
    lines = lines.select("__l.*", F.col("line").alias("__pred"))
    lines = evaluator_gold_lines(lines.withColumn("__l", F.struct("question_id", "__pred")), "__l").select(
        "__l.question_id", "__l.__pred", F.col("line").alias("__gold"))
    return write_aligned(lines, ["question_id"], {"pred": F.col("__pred"), "gold": F.col("__gold")}, path, rows_per_file)


def read_evaluator_files(spark, path: str) -> DataFrame:
    """The newest committed pair of A8 files: (line_no, pred_line, gold_sql, db_id)."""
    from ..sources.lines import read_aligned

    return read_aligned(spark, path, ["pred", "gold"]).select(
        "line_no", F.col("pred").alias("pred_line"), F.regexp_replace("gold", r"(?s)\t[^\t]*$", "").alias("gold_sql"),
        F.substring_index("gold", "\t", -1).alias("db_id"))




def evaluator_printout(summary: DataFrame, run_col: str = "run") -> DataFrame:
    """The evaluator's closing table as text lines per run (the A14 input format): a header,
    then ``execution`` and ``exact match`` rows with easy/medium/hard/extra/all at 3 dp
    (half-even first, so the printed digits do not depend on the formatter's rounding)."""
    def cell(metric: str, b: str) -> Column:
        v = F.first(F.when(F.col("difficulty") == b, F.col(metric)), ignorenulls=True)
        return F.format_string("%.3f", F.bround(F.coalesce(v, F.lit(0.0)), 3))

    per = summary.groupBy(run_col).agg(
        *[cell("exec_accuracy", b).alias(f"e_{b}") for b in EVAL_BUCKETS],
        *[cell("exact_match_accuracy", b).alias(f"m_{b}") for b in EVAL_BUCKETS],
    )
    head = F.lit("                     easy                 medium               hard                 extra                all")
    ex = F.concat_ws("     ", F.lit("execution         "), *[F.col(f"e_{b}") for b in EVAL_BUCKETS])
    em = F.concat_ws("     ", F.lit("exact match       "), *[F.col(f"m_{b}") for b in EVAL_BUCKETS])
    lines = F.array(
        F.struct(F.lit(0).alias("line_no"), head.alias("value")),
        F.struct(F.lit(1).alias("line_no"), ex.alias("value")),
        F.struct(F.lit(2).alias("line_no"), em.alias("value")),
    )
    return per.select(run_col, F.inline(lines))


def parse_evaluator_printout(lines: DataFrame, run_col: str = "run", text_col: str = "value",
                             pos_col: str | None = None) -> DataFrame:
    """Evaluator stdout lines -> (run, metric, bucket, value).

    The last printed line per (run, metric) wins (dict semantics). A run missing either metric
    fails the job via ``raise_error``.
    """
    pos = F.col(pos_col) if pos_col else F.monotonically_increasing_id()
    m = lines.select(
        run_col,
        pos.alias("__pos"),
        F.regexp_extract(text_col, EVAL_LINE_RE, 1).alias("metric"),
        *[F.regexp_extract(text_col, EVAL_LINE_RE, i + 2).alias(b) for i, b in enumerate(EVAL_BUCKETS)],
    ).filter(F.col("metric") != "")
    last = last_wins(m, [run_col, "metric"], "__pos")
    stack = ", ".join(f"'{b}', `{b}`" for b in EVAL_BUCKETS)
    long = last.select(run_col, "metric", F.expr(f"stack({len(EVAL_BUCKETS)}, {stack}) as (bucket, value_s)"))
    long = long.select(run_col, "metric", "bucket", F.col("value_s").cast("double").alias("value"))
    check = long.groupBy(run_col).agg(F.count_if(F.col("metric") == "execution").alias("ne"),
                                      F.count_if(F.col("metric") == "exact match").alias("nm"))
    ok = F.when((F.col("ne") == 0) | (F.col("nm") == 0),
                F.raise_error(F.lit("evaluator output lacks execution/exact match rows"))).otherwise(F.lit(True))
    return long.join(check, on=run_col).filter(ok.isNull() | ok).drop("ne", "nm")


def overlay_metrics(summary: DataFrame, official: DataFrame, run_col: str = "run",
                    all_buckets: bool = False) -> DataFrame:
    """External accuracy overlaid on the in-process summary (both kept, T5).

    ``summary``: run, difficulty, n, exec_accuracy, ...; ``official``: run, metric, bucket, value.
    The overlay takes the external execution number where present, the local one otherwise.
    ``all_buckets=True`` is the other variant: every run gets all four buckets plus 'all',
    with ``n`` 0 where the run has no question of that bucket.
    """
    off = official.filter(F.col("metric") == "execution").select(
        run_col, F.col("bucket").alias("difficulty"), F.col("value").alias("official_exec")
    )
    base = summary
    if all_buckets:
        # runs x 5 buckets: an explode of a 5-element literal, not a join with a data table.
        grid = summary.select(run_col).distinct().select(
            run_col, F.explode(F.array(*[F.lit(b) for b in EVAL_BUCKETS])).alias("difficulty"))
        base = grid.join(summary, on=[run_col, "difficulty"], how="left").withColumn(
            "n", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))
    return base.join(off, on=[run_col, "difficulty"], how="left").withColumn(
        "exec_overlay", F.coalesce(F.col("official_exec"), F.col("exec_accuracy"))
    )
