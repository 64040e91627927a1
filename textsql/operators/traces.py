"""Candidate evaluation and trace selection.

One question's candidates are reduced with ``min`` over ordered structs -- a partial aggregate,
so a question with millions of candidates never lands whole in one task -- and the pipeline's
choice rules become a CASE over the three "first" candidates (first matching, first executable,
first overall).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import grounded, referenced_tables, stored_sql
from ..schemas import TRACE

# --- fixed values -----------------------------------------------------------------------------
DROP_REASONS = (
    "gold-failed", "missing-schema", "no-candidates", "no-match", "no-executable", "parse-error",
    "no-sql", "ungrounded",
)
# ----------------------------------------------------------------------------------------------

_PAYLOAD = ("sql", "parses_ok", "executes_ok", "matches_gold")


def _packed(order_cols) -> Column:
    return F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in _PAYLOAD])


def select_candidates(
    questions: DataFrame,
    candidates: DataFrame,
    schema_tables: DataFrame | None = None,
    order_cols=("sample_index",),
    require_executes: bool = True,
    require_matches_gold: bool = True,
    fallback_executes_only: bool = True,
    require_parse: bool = True,
    require_table_grounded: bool = True,
) -> DataFrame:
    """W1 + F6: one row per question: ``kept``, ``drop_reason`` (NULL when kept) and the chosen
    candidate's fields.

    questions: (question_id, db_id, gold_ok, has_schema[, api_error]); candidates: (question_id, <order_cols>,
    sql, parses_ok, executes_ok, matches_gold); schema_tables: (db_id, tables array<string>).
    Candidates are ordered by ``order_cols`` (sample index first, then any total tie-break).
    """
    order_cols = list(order_cols)
    packed = _packed(order_cols)
    per_q = candidates.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.min(F.when(F.col("matches_gold"), packed)).alias("first_match"),
        F.min(F.when(F.col("executes_ok"), packed)).alias("first_exec"),
        F.min(packed).alias("first_any"),
    )
    q = questions.join(per_q, on="question_id", how="left")
    if schema_tables is not None:
        q = q.join(schema_tables.select("db_id", F.col("tables").alias("__tables")), on="db_id", how="left")
    has_match = F.col("first_match").isNotNull()
    if require_matches_gold:
        chosen = F.when(has_match, F.col("first_match")).otherwise(
            F.col("first_exec") if fallback_executes_only else F.lit(None))
    else:
        chosen = F.coalesce(F.col("first_match"), F.col("first_any"))
    q = q.withColumn("__c", chosen)
    c = F.col("__c")
    refs = referenced_tables(c["sql"])
    ground_ok = grounded(refs, F.coalesce(F.col("__tables"), F.array().cast("array<string>"))) \
        if schema_tables is not None else F.lit(True)
    reason = F.when(require_matches_gold & ~F.coalesce(F.col("gold_ok"), F.lit(False)), "gold-failed") \
        .when(~F.coalesce(F.col("has_schema"), F.lit(False)), "missing-schema")
    if "api_error" in questions.columns:
        # Sampling failed after retries: the reason names the error class (``api-<Error>``).
        reason = reason.when(F.col("api_error").isNotNull(), F.concat(F.lit("api-"), F.col("api_error")))
    reason = reason.when(F.coalesce(F.col("n_candidates"), F.lit(0)) == 0, "no-candidates")
    if require_matches_gold:
        reason = reason.when(~has_match & F.lit(not fallback_executes_only), "no-match") \
            .when(~has_match & F.col("first_exec").isNull(), "no-executable")
    if require_executes:
        reason = reason.when(~c["executes_ok"], "no-executable")
    if require_parse:
        reason = reason.when(~c["parses_ok"], "parse-error")
    reason = reason.when(c["sql"].isNull() | (c["sql"] == ""), "no-sql")
    if require_table_grounded:
        reason = reason.when(~ground_ok, "ungrounded")
    out = q.withColumn("drop_reason", reason)
    # Questions dropped before sampling (F6) or whose sampling failed contribute no candidates.
    pre_drop = F.col("drop_reason").isin("gold-failed", "missing-schema") | F.col("drop_reason").startswith("api-")
    return out.select(
        "question_id", "db_id",
        F.col("drop_reason").isNull().alias("kept"),
        "drop_reason",
        F.when(pre_drop, F.lit(0)).otherwise(F.coalesce(F.col("n_candidates"), F.lit(0))).cast("bigint").alias("n_candidates"),
        c[order_cols[0]].alias("chosen_index"),
        c["sql"].alias("chosen_sql"),
        F.coalesce(c["matches_gold"], F.lit(False)).alias("matched_gold"),
    )


def candidate_funnel(selection: DataFrame, candidates: DataFrame) -> DataFrame:
    """Seen / kept / dropped questions and the candidate counts of questions that were
    sampled (pre-dropped questions contribute no candidates). One partial aggregate per side,
    joined on question_id, then a single global aggregate."""
    per_q = candidates.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("c_total"),
        F.count_if("parses_ok").alias("c_parse"),
        F.count_if("executes_ok").alias("c_exec"),
        F.count_if("matches_gold").alias("c_match"),
    )
    dr = F.coalesce(F.col("drop_reason"), F.lit(""))
    sampled = ~(dr.isin("gold-failed", "missing-schema") | dr.startswith("api-"))
    j = selection.join(per_q, on="question_id", how="left")

    def csum(c: str) -> Column:
        return F.coalesce(F.sum(F.when(sampled, F.col(c))), F.lit(0)).cast("bigint")

    return j.agg(
        F.count(F.lit(1)).alias("examples_seen"),
        F.count_if("kept").alias("examples_kept"),
        F.count_if(~F.col("kept")).alias("examples_dropped"),
        csum("c_total").alias("candidates_total"),
        csum("c_parse").alias("candidates_parse_ok"),
        csum("c_exec").alias("candidates_execute_ok"),
        csum("c_match").alias("candidates_match_gold"),
    )


def drop_reasons(selection: DataFrame) -> DataFrame:
    """Histogram of drop reasons."""
    return selection.filter(~F.col("kept")).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def build_traces(selection: DataFrame, examples: DataFrame, modes: DataFrame,
                 schema_blocks: DataFrame | None = None, reasoning: DataFrame | None = None) -> DataFrame:
    """A5 row shape: one trace per kept question, ordered by question_id.

    ``sql`` is the stored form (P27); ``reasoning`` survives only in reasoning mode.
    """
    t = selection.filter("kept").join(examples.select("question_id", "question", F.col("query").alias("gold_sql")),
                                      on="question_id").join(modes, on="question_id", how="left")
    if schema_blocks is not None:
        t = t.join(schema_blocks, on="question_id", how="left")
    else:
        t = t.withColumn("schema_block", F.lit(""))
    if reasoning is not None:
        t = t.join(reasoning, on="question_id", how="left")
    else:
        t = t.withColumn("reasoning", F.lit(None).cast("string"))
    return t.select(
        "question_id", "db_id", "question", "schema_block", "mode",
        stored_sql("chosen_sql").alias("sql"),
        F.when(F.col("mode") == "reasoning", F.col("reasoning")).alias("reasoning"),
        "gold_sql", "n_candidates", "matched_gold",
    ).orderBy("question_id")


def write_traces(traces: DataFrame, path: str, fmt: str = "json") -> None:
    """A5 sink: JSON lines (or parquet) ordered by question_id."""
    traces.orderBy("question_id").write.mode("overwrite").format(fmt).save(path)


def write_ordered_traces(traces: DataFrame, path: str, rows_per_file: int = 1_000_000) -> int:
    """A5 as committed parts: one JSON line a trace in ``question_id`` order, null fields written out. A retry
    replaces the traces of the run before it."""
    from ..sources.lines import write_aligned

    line = F.to_json(F.struct(*[f.name for f in TRACE.fields]), {"ignoreNullFields": "false"})
    return write_aligned(traces, ["question_id"], {"trace": line}, path, rows_per_file)


def read_ordered_traces(spark, path: str) -> DataFrame:
    """The newest committed traces with their line numbers."""
    from ..sources.lines import read_aligned

    return read_aligned(spark, path, ["trace"]).select("line_no", F.from_json("trace", TRACE).alias("t")).select("line_no", "t.*")


def write_stats(funnel: DataFrame, reasons: DataFrame, cost_usd: Column | float, path: str) -> None:
    """A6 sink: one JSON document with the funnel, the drop-reason map and cost (4 dp).

    The histogram has one entry per drop reason (a handful, by construction), so it is fetched
    and attached to the one-row funnel as a literal map -- no pairing join."""
    hist = {r["drop_reason"]: int(r["n"]) for r in reasons.collect()}
    entries = [x for k, v in sorted(hist.items()) for x in (F.lit(k), F.lit(v).cast("bigint"))]
    m = F.create_map(*entries) if entries else F.create_map().cast("map<string,bigint>")
    cost = cost_usd if isinstance(cost_usd, Column) else F.lit(float(cost_usd))
    (funnel.withColumn("drop_reasons", m).withColumn("cost_usd", F.round(cost, 4))
     .coalesce(1).write.mode("overwrite").json(path))
