"""Registered queries: one Spark plan per operator family plus its DuckDB oracle text.

Each query takes ``(spark, sf_dir)``, reads the driver tables (through the views in
``views.py``) and returns a DataFrame whose column names equal the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext as st
from ..functions.prompts import extract_sql, split_reasoning
from ..operators import evaluate as ev
from ..operators.resultset import multiset_equal
from . import views as V
from .views import clean_sql_sql, strip_sql, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ==============================================================================================
# Evaluation core: X2, G1-G3, P18, G12
# ==============================================================================================

@register("exec_match_by_question", with_views(["v_rows"], """
, g AS (SELECT question_id, list_transform(row, lambda x: coalesce(x, '')) AS row, count(*) AS c
        FROM v_gold_rows GROUP BY ALL),
  p AS (SELECT question_id, list_transform(row, lambda x: coalesce(x, '')) AS row, count(*) AS c
        FROM v_pred_rows GROUP BY ALL)
SELECT coalesce(g.question_id, p.question_id) AS question_id,
       bool_and(coalesce(g.c, 0) = coalesce(p.c, 0)) AS exec_match
FROM g FULL OUTER JOIN p ON g.question_id = p.question_id AND g.row = p.row
GROUP BY 1"""))
def q_exec_match_by_question(spark, sf):
    return multiset_equal(V.gold_rows(spark, sf), V.pred_rows(spark, sf), key="question_id")


@register("eval_summary", with_views(["v_outcomes"], """
SELECT run, CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE difficulty END AS difficulty,
       count(*) AS n,
       round(sum(CAST(exec_match AS INTEGER)) / count(*), 6) AS exec_accuracy,
       round(sum(CAST(exact_set_match AS INTEGER)) / count(*), 6) AS exact_match_accuracy
FROM v_outcomes GROUP BY GROUPING SETS ((run), (run, difficulty))"""))
def q_eval_summary(spark, sf):
    return ev.summarize(V.outcomes(spark, sf))


def _fb_sql() -> str:
    cols = []
    for m in st.FAILURE_MODES:
        a = m.replace("-", "_")
        cols.append(f"CAST(count_if(failure_mode = '{m}') AS BIGINT) AS {a}")
    pcts = []
    for m in st.FAILURE_MODES:
        a = m.replace("-", "_")
        pcts.append(f"round(CASE WHEN total > 0 THEN 100.0 * {a} / total ELSE 0.0 END, 4) AS pct_{a}")
    return with_views(["v_outcomes"], f"""
, c AS (SELECT run, count(*) AS total, {', '.join(cols)} FROM v_outcomes GROUP BY run)
SELECT *, {', '.join(pcts)} FROM c""")


@register("failure_breakdown", _fb_sql())
def q_failure_breakdown(spark, sf):
    return ev.failure_breakdown(V.outcomes(spark, sf))


@register("classify_failure", with_views(["v_outcomes"], f"""
SELECT run, question_id, {V.failure_mode_sql('pred_sql', 'parses', 'executes', 'exec_match')} AS failure_mode
FROM v_outcomes"""))
def q_classify_failure(spark, sf):
    o = V.outcomes(spark, sf)
    return o.select("run", "question_id",
                    st.classify_failure("pred_sql", "parses", "executes", "exec_match").alias("failure_mode"))


def _leaderboard_sql() -> str:
    buckets = ", ".join(
        f"round(CASE WHEN count_if(difficulty = '{b}') > 0 THEN "
        f"count_if(difficulty = '{b}' AND exec_match) / count_if(difficulty = '{b}') ELSE 0.0 END, 6) AS {b}"
        for b in st.DIFFICULTY_BUCKETS)
    return with_views(["v_outcomes"], f"""
, labels(run, label) AS (VALUES ('base', 'Base model'), ('student', 'Student model'))
SELECT o.run, count(*) AS n, round(avg(CAST(exec_match AS DOUBLE)), 6) AS exec_accuracy,
       round(avg(CAST(exact_set_match AS DOUBLE)), 6) AS exact_match_accuracy, {buckets},
       coalesce(any_value(l.label), o.run) AS label
FROM v_outcomes o LEFT JOIN labels l ON l.run = o.run GROUP BY o.run""")


@register("leaderboard", _leaderboard_sql())
def q_leaderboard(spark, sf):
    labels = spark.createDataFrame([("base", "Base model"), ("student", "Student model")], "run string, label string")
    return ev.leaderboard(V.outcomes(spark, sf), labels=labels)


# ==============================================================================================
# SQL text: P15-P17, P19, P12, P13, F1
# ==============================================================================================

def _difficulty_sql(x: str) -> str:
    s = f"lower({x})"
    terms = " + ".join(f"CAST((length({s}) - length(replace({s}, '{kw}', ''))) // {len(kw)} AS BIGINT)"
                       for kw in st.HARDNESS_KEYWORDS)
    first = f"instr({s}, 'select')"
    removed = (f"CASE WHEN {first} = 0 THEN {s} ELSE concat(substr({s}, 1, {first} - 1), "
               f"substr({s}, {first} + 6)) END")
    score = f"({terms} + CASE WHEN contains({removed}, 'select') THEN 2 ELSE 0 END)"
    return score


@register("sql_difficulty", with_views(["v_sql_pairs"], f"""
, s AS (SELECT question_id, {_difficulty_sql('gold_sql')} AS score FROM v_sql_pairs)
SELECT question_id, score AS hardness,
       CASE WHEN score <= 1 THEN 'easy' WHEN score <= 3 THEN 'medium' WHEN score <= 5 THEN 'hard'
            ELSE 'extra' END AS difficulty
FROM s"""))
def q_sql_difficulty(spark, sf):
    p = V.sql_pairs(spark, sf)
    return p.select("question_id", st.hardness_score("gold_sql").alias("hardness"),
                    st.difficulty("gold_sql").alias("difficulty"))


@register("exact_match", with_views(["v_sql_pairs"], f"""
SELECT question_id, coalesce({clean_sql_sql('pred_sql')}, '') AS pred_clean,
       lower(coalesce({clean_sql_sql('pred_sql')}, '')) = lower(coalesce({clean_sql_sql('gold_sql')}, '')) AS exact_set_match
FROM v_sql_pairs"""))
def q_exact_match(spark, sf):
    from ..functions.text import clean_sql

    p = V.sql_pairs(spark, sf)
    return p.select("question_id", F.coalesce(clean_sql("pred_sql"), F.lit("")).alias("pred_clean"),
                    st.exact_match("pred_sql", "gold_sql").alias("exact_set_match"))


def _agg_names_sql(x: str) -> str:
    return (f"list_sort(list_distinct(regexp_extract_all({x}, '{st.AGG_CALL_RE}', 1)))")


def _category_sql(gold: str, pred: str, failure: str) -> str:
    g, p = f"lower(coalesce({gold}, ''))", f"lower(coalesce({pred}, ''))"
    f = f"coalesce({failure}, '')"
    return f"""CASE WHEN {f} = 'empty' THEN 'empty-output'
  WHEN {f} = 'parse' THEN 'parse-error'
  WHEN {f} = 'execution' THEN 'schema-mismatch'
  WHEN contains({g}, ' join ') AND NOT contains({p}, ' join ') THEN 'missing-join'
  WHEN contains({p}, ' join ') AND NOT contains({g}, ' join ') THEN 'spurious-join'
  WHEN {_agg_names_sql(g)} <> {_agg_names_sql(p)} THEN 'aggregation-mismatch'
  WHEN contains({g}, ' group by ') AND NOT contains({p}, ' group by ') THEN 'missing-group-by'
  WHEN contains({g}, ' where ') AND NOT contains({p}, ' where ') THEN 'missing-filter'
  WHEN NOT contains({g}, ' where ') AND contains({p}, ' where ') THEN 'spurious-filter'
  WHEN contains({g}, ' order by ') AND NOT contains({p}, ' order by ') THEN 'missing-order'
  WHEN contains({g}, 'distinct') AND NOT contains({p}, 'distinct') THEN 'missing-distinct'
  ELSE 'other' END"""


@register("error_category", with_views(["v_sql_pairs"], f"""
SELECT question_id, {_category_sql('gold_sql', 'pred_sql', 'failure')} AS category FROM v_sql_pairs"""))
def q_error_category(spark, sf):
    p = V.sql_pairs(spark, sf)
    return p.select("question_id", st.error_category("gold_sql", "pred_sql", "failure").alias("category"))


# The oracles of these three have the expected texts written out for each template (no shared pattern).
_PAIR_KEYS = ", o AS (SELECT o_orderkey AS question_id, o_custkey, o_orderkey, o_totalprice FROM orders)"


@register("statement_fingerprint", with_views(["v_sql_pairs"], f"""
{_PAIR_KEYS}
, f AS (SELECT question_id, {V.by_template_sql([g for g, _ in V.PAIR_FINGERPRINTS])} AS gold_fp,
               {V.by_template_sql([p for _, p in V.PAIR_FINGERPRINTS])} AS pred_fp FROM o)
SELECT question_id, gold_fp, pred_fp, sha256(pred_fp) AS pred_fp_sha256, gold_fp = pred_fp AS same_statement FROM f"""))
def q_statement_fingerprint(spark, sf):
    p = V.sql_pairs(spark, sf)
    f = p.select("question_id", st.fingerprint("gold_sql").alias("gold_fp"), st.fingerprint("pred_sql").alias("pred_fp"))
    return f.select("*", F.sha2("pred_fp", 256).alias("pred_fp_sha256"),
                    (F.col("gold_fp") == F.col("pred_fp")).alias("same_statement"))


_FOLD_ROWS = 50_000  # pairs of a task that reads statements token by token


@register("referenced_tables", with_views(["v_sql_pairs"], f"""
{_PAIR_KEYS}
SELECT question_id, {V.by_template_sql([g for g, _ in V.PAIR_TABLES])} AS gold_tables,
       {V.by_template_sql([p for _, p in V.PAIR_TABLES])} AS pred_tables FROM o"""))
def q_referenced_tables(spark, sf):
    p = V.sql_pairs(spark, sf, rows_per_task=_FOLD_ROWS)
    return p.select("question_id", F.array_join(st.referenced_tables("gold_sql"), ",").alias("gold_tables"),
                    F.array_join(st.referenced_tables("pred_sql"), ",").alias("pred_tables"))


_TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@register("grounding", with_views(["v_sql_pairs"], f"""
{_PAIR_KEYS}
, r AS (SELECT question_id, list_filter(string_split({V.by_template_sql([p for _, p in V.PAIR_TABLES])}, ','), lambda x: x <> '') AS refs FROM o)
SELECT question_id, len(refs) = 0 OR len(list_intersect(refs, {list(_TPCH_TABLES)})) > 0 AS grounded FROM r"""))
def q_grounding(spark, sf):
    p = V.sql_pairs(spark, sf, rows_per_task=_FOLD_ROWS)
    tables = F.array(*[F.lit(t) for t in _TPCH_TABLES])
    return p.select("question_id", st.grounded(st.referenced_tables("pred_sql"), tables).alias("grounded"))


# ==============================================================================================
# Completions: P10, P11
# ==============================================================================================

def _fence_sql() -> str:
    from ..functions.prompts import FENCE_RE
    return FENCE_RE


def _extract_sql_sql(x: str) -> str:
    fence = _fence_sql()
    bodies = f"regexp_extract_all({x}, '{fence}', 1)"
    s = strip_sql(x)
    starts = " OR ".join(f"starts_with(lower({s}), '{p}')" for p in ("select ", "with ", "insert ", "update ", "delete "))
    bare = f"CASE WHEN {starts} THEN {strip_sql(f'rtrim({s}, chr(59))')} END"
    return f"CASE WHEN len({bodies}) > 0 THEN {clean_sql_sql(f'{bodies}[-1]')} ELSE {bare} END"


def _split_reasoning_sql(x: str) -> str:
    fence = _fence_sql()
    fences = f"regexp_extract_all({x}, '{fence}', 0)"
    gaps = f"regexp_split_to_array({x}, '{fence}')"
    m = f"len({fences})"
    start = (f"length(array_to_string(list_slice({gaps}, 1, {m}), '')) + "
             f"length(array_to_string(list_slice({fences}, 1, greatest({m} - 1, 0)), ''))")
    prefix = strip_sql(f"substr({x}, 1, {start})")
    return f"CASE WHEN {m} > 0 AND {prefix} <> '' THEN {prefix} END"


@register("extract_sql", with_views(["v_completions"], f"""
, e AS (SELECT doc_id, {_extract_sql_sql('text')} AS sql FROM v_completions)
SELECT doc_id, coalesce(sql, '') AS sql, sql IS NULL AS sql_missing FROM e"""))
def q_extract_sql(spark, sf):
    c = V.completions(spark, sf)
    e = c.select("doc_id", extract_sql("text").alias("sql"))
    return e.select("doc_id", F.coalesce("sql", F.lit("")).alias("sql"), F.col("sql").isNull().alias("sql_missing"))


@register("split_reasoning", with_views(["v_completions"], f"""
, e AS (SELECT doc_id, {_split_reasoning_sql('text')} AS reasoning, {_extract_sql_sql('text')} AS sql FROM v_completions)
SELECT doc_id, coalesce(reasoning, '') AS reasoning, reasoning IS NULL AS reasoning_missing,
       coalesce(sql, '') AS sql FROM e"""))
def q_split_reasoning(spark, sf):
    c = V.completions(spark, sf)
    e = c.select("doc_id", split_reasoning("text").alias("reasoning"), extract_sql("text").alias("sql"))
    return e.select("doc_id", F.coalesce("reasoning", F.lit("")).alias("reasoning"),
                    F.col("reasoning").isNull().alias("reasoning_missing"),
                    F.coalesce("sql", F.lit("")).alias("sql"))


# ==============================================================================================
# Flagship: X2 feeding the GROUPING SETS roll-up
# ==============================================================================================

@register("flagship_eval", with_views(["v_rows"], """
, g AS (SELECT question_id, list_transform(row, lambda x: coalesce(x, '')) AS row, count(*) AS c
        FROM v_gold_rows GROUP BY ALL),
  p AS (SELECT question_id, list_transform(row, lambda x: coalesce(x, '')) AS row, count(*) AS c
        FROM v_pred_rows GROUP BY ALL),
  m AS (SELECT coalesce(g.question_id, p.question_id) AS question_id,
               bool_and(coalesce(g.c, 0) = coalesce(p.c, 0)) AS exec_match
        FROM g FULL OUTER JOIN p ON g.question_id = p.question_id AND g.row = p.row GROUP BY 1),
  o AS (SELECT 'replay' AS run,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'easy' WHEN '2' THEN 'medium'
                    WHEN '3' THEN 'hard' WHEN '4' THEN 'extra' ELSE 'unknown' END AS difficulty,
               m.exec_match
        FROM orders JOIN m ON m.question_id = o_orderkey)
SELECT run, CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE difficulty END AS difficulty, count(*) AS n,
       round(sum(CAST(exec_match AS INTEGER)) / count(*), 6) AS exec_accuracy,
       round(sum(CAST(exec_match AS INTEGER)) / count(*), 6) AS exact_match_accuracy
FROM o GROUP BY GROUPING SETS ((run), (run, difficulty))"""))
def q_flagship_eval(spark, sf):
    from .flagship import flagship

    return flagship(spark, sf)


# ==============================================================================================
# Schema linking: P6, G7, J10, W2, J6, W3
# ==============================================================================================

def _terms_sql(x: str) -> str:
    from ..operators.linking import TOKEN_RE
    words = f"regexp_extract_all(lower({x}), '{TOKEN_RE}', 0)"
    return (f"flatten(list_transform({words}, lambda w: list_concat(list_filter(string_split(w, '_'), lambda p: p <> ''), "
            f"CASE WHEN contains(w, '_') THEN [w] ELSE CAST([] AS VARCHAR[]) END)))")


@register("tokenize_terms", f"""
WITH t AS (SELECT doc_id, {_terms_sql('text')} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_terms, md5(array_to_string(toks, ' ')) AS terms_md5 FROM t""")
def q_tokenize_terms(spark, sf):
    from ..operators.linking import tokenize

    d = V.read(spark, sf, "documents").select("doc_id", tokenize("text").alias("toks"))
    return d.select("doc_id", F.size("toks").cast("bigint").alias("n_terms"),
                    F.md5(F.array_join("toks", " ")).alias("terms_md5"))


def _bm25_sql_ctes() -> str:
    from ..operators.linking import BM25_B, BM25_K1, BM25_MIN_DENOM
    return f"""
, docs AS (SELECT db_id, table_index, {_terms_sql('text')} AS toks FROM v_corpus)
, d2 AS (SELECT db_id, table_index, len(toks) AS dl, toks FROM docs)
, stats AS (SELECT db_id, count(*) AS n_docs, avg(dl) AS avgdl FROM d2 GROUP BY db_id)
, qtok AS (SELECT question_id, db_id, unnest({_terms_sql('question')}) AS term FROM v_questions)
, qt AS (SELECT question_id, db_id, term, count(*) AS qtf FROM qtok GROUP BY ALL)
, vocab AS (SELECT DISTINCT db_id, term FROM qt)
, dtok AS (SELECT db_id, table_index, dl, unnest(toks) AS term FROM d2)
, post AS (SELECT d.db_id, d.table_index, d.term, count(*) AS tf, any_value(d.dl) AS dl
           FROM dtok d JOIN vocab v ON v.db_id = d.db_id AND v.term = d.term GROUP BY ALL)
, dfs AS (SELECT db_id, term, count(*) AS df FROM post GROUP BY ALL)
, idf AS (SELECT dfs.db_id, term, avgdl, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf
          FROM dfs JOIN stats ON stats.db_id = dfs.db_id)
, scores AS (
  SELECT qt.question_id, p.db_id, p.table_index,
         sum(qt.qtf * i.idf * (p.tf * ({BM25_K1} + 1)) /
             greatest(p.tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * CASE WHEN i.avgdl > 0 THEN p.dl / i.avgdl ELSE 0.0 END),
                      {BM25_MIN_DENOM})) AS score
  FROM post p JOIN qt ON qt.db_id = p.db_id AND qt.term = p.term
       JOIN idf i ON i.db_id = p.db_id AND i.term = p.term
  GROUP BY ALL)"""


@register("bm25_scores", with_views(["v_corpus", "v_source_questions"], _bm25_sql_ctes() + """
SELECT question_id, db_id, table_index, round(score, 6) AS score FROM scores"""))
def q_bm25_scores(spark, sf):
    from ..operators.linking import bm25_scores

    s = bm25_scores(V.corpus(spark, sf), V.source_questions(spark, sf))
    return s.select("question_id", "db_id", "table_index", F.round("score", 6).alias("score"))


def _topk_sql(k: int) -> str:
    return f"""
, firsts AS (SELECT db_id, table_index FROM
             (SELECT db_id, table_index, row_number() OVER (PARTITION BY db_id ORDER BY table_index) AS r FROM v_corpus)
             WHERE r <= {k})
, fill AS (SELECT q.question_id, q.db_id, f.table_index, 0.0 AS score FROM v_questions q JOIN firsts f ON f.db_id = q.db_id)
, cand AS (SELECT question_id, db_id, table_index, max(score) AS score FROM
           (SELECT question_id, db_id, table_index, score FROM scores UNION ALL SELECT * FROM fill) GROUP BY ALL)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, table_index) AS rank
             FROM cand)"""


@register("bm25_topk", with_views(["v_corpus", "v_source_questions"], _bm25_sql_ctes() + _topk_sql(2) + """
SELECT question_id, db_id, table_index, round(score, 6) AS score, rank FROM ranked WHERE rank <= 2"""))
def q_bm25_topk(spark, sf):
    from ..operators.linking import bm25_scores, top_tables

    c, q = V.corpus(spark, sf), V.source_questions(spark, sf)
    t = top_tables(bm25_scores(c, q), c, q, k=2)
    return t.select("question_id", "db_id", "table_index", F.round("score", 6).alias("score"),
                    F.col("rank").cast("bigint").alias("rank"))


@register("schema_prune", with_views(["v_corpus", "v_source_questions", "v_fk_edges"], _bm25_sql_ctes() + _topk_sql(2) + """
, sizes AS (SELECT db_id, sum(length(text)) + 2 * (count(*) - 1) AS full_chars FROM v_corpus GROUP BY db_id)
, seeds AS (SELECT question_id, db_id, list(table_index) AS seed FROM ranked WHERE rank <= 2 GROUP BY ALL)
, fks AS (SELECT db_id, list(struct_pack(f := from_table, t := to_table) ORDER BY pos) AS fks
          FROM v_fk_edges GROUP BY db_id)
, closed AS (
  SELECT s.question_id, s.db_id,
         list_reduce(coalesce(f.fks, []), lambda acc, fk:
             CASE WHEN list_contains(acc, fk.f) OR list_contains(acc, fk.t)
                  THEN list_distinct(list_concat(acc, [fk.f, fk.t])) ELSE acc END, s.seed) AS kept
  FROM seeds s LEFT JOIN fks f ON f.db_id = s.db_id)
, over_budget AS (
  SELECT c.question_id, c.db_id, unnest(c.kept) AS table_index
  FROM closed c JOIN sizes z ON z.db_id = c.db_id WHERE NOT (z.full_chars <= 5000))
, in_budget AS (
  SELECT q.question_id, q.db_id, v.table_index FROM v_questions q JOIN sizes z ON z.db_id = q.db_id
  JOIN v_corpus v ON v.db_id = q.db_id WHERE z.full_chars <= 5000)
SELECT question_id, db_id, table_index FROM over_budget UNION ALL SELECT * FROM in_budget"""))
def q_schema_prune(spark, sf):
    from ..operators.linking import prune_schema

    return prune_schema(V.corpus(spark, sf), V.source_questions(spark, sf), V.fk_edges(spark, sf))


# ==============================================================================================
# Candidate choice and funnel: W1, F6, G4, G5
# ==============================================================================================

_CAND_ORDER = ("sample_index", "sample_key")


def _selection(spark, sf):
    from ..operators.traces import select_candidates

    q = V.cand_questions(spark, sf)
    tables = q.select("db_id").distinct().withColumn("tables", F.array(*[F.lit(t) for t in _TPCH_TABLES]))
    return select_candidates(q, V.candidates(spark, sf), tables, order_cols=_CAND_ORDER)


_PACK_SQL = "struct_pack(sample_index, k_a, k_b, k_c, k_d, k_e, sql, parses_ok, executes_ok, matches_gold)"


def _selection_sql() -> str:
    ground = "(NOT contains(ch.sql, 'FROM ghost_table '))"  # the one table of the fixture's statements that no schema has
    return with_views(["v_candidates"], f"""
, per_q AS (SELECT question_id, count(*) AS n_candidates,
                   min({_PACK_SQL}) FILTER (WHERE matches_gold) AS first_match,
                   min({_PACK_SQL}) FILTER (WHERE executes_ok) AS first_exec
            FROM v_candidates GROUP BY question_id)
, q AS (SELECT c.*, p.n_candidates, p.first_match, p.first_exec,
               CASE WHEN p.first_match IS NOT NULL THEN p.first_match ELSE p.first_exec END AS ch
        FROM v_cand_questions c LEFT JOIN per_q p ON p.question_id = c.question_id)
, r AS (SELECT *, CASE WHEN NOT coalesce(gold_ok, false) THEN 'gold-failed'
                       WHEN NOT coalesce(has_schema, false) THEN 'missing-schema'
                       WHEN coalesce(n_candidates, 0) = 0 THEN 'no-candidates'
                       WHEN first_match IS NULL AND first_exec IS NULL THEN 'no-executable'
                       WHEN NOT ch.executes_ok THEN 'no-executable'
                       WHEN NOT ch.parses_ok THEN 'parse-error'
                       WHEN ch.sql IS NULL OR ch.sql = '' THEN 'no-sql'
                       WHEN NOT {ground} THEN 'ungrounded' END AS drop_reason
        FROM q)
, sel AS (SELECT question_id, db_id, drop_reason IS NULL AS kept, drop_reason,
                 CAST(CASE WHEN drop_reason IN ('gold-failed', 'missing-schema') THEN 0
                           ELSE coalesce(n_candidates, 0) END AS BIGINT) AS n_candidates,
                 ch.sample_index AS chosen_index, ch.sql AS chosen_sql,
                 coalesce(ch.matches_gold, false) AS matched_gold
          FROM r)""")


@register("select_candidate", _selection_sql() + """
SELECT question_id, db_id, kept, coalesce(drop_reason, '') AS drop_reason, n_candidates,
       coalesce(chosen_index, -1) AS chosen_index, coalesce(chosen_sql, '') AS chosen_sql, matched_gold
FROM sel""")
def q_select_candidate(spark, sf):
    s = _selection(spark, sf)
    return s.select("question_id", "db_id", "kept", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"),
                    "n_candidates", F.coalesce("chosen_index", F.lit(-1)).cast("bigint").alias("chosen_index"),
                    F.coalesce("chosen_sql", F.lit("")).alias("chosen_sql"), "matched_gold")


@register("candidate_funnel", _selection_sql() + """
, per_c AS (SELECT question_id, count(*) AS c_total, count_if(parses_ok) AS c_parse,
                   count_if(executes_ok) AS c_exec, count_if(matches_gold) AS c_match
            FROM v_candidates GROUP BY question_id)
, j AS (SELECT s.*, p.c_total, p.c_parse, p.c_exec, p.c_match,
               NOT coalesce(s.drop_reason, '') IN ('gold-failed', 'missing-schema') AS sampled
        FROM sel s LEFT JOIN per_c p ON p.question_id = s.question_id)
SELECT count(*) AS examples_seen, CAST(count_if(kept) AS BIGINT) AS examples_kept,
       CAST(count_if(NOT kept) AS BIGINT) AS examples_dropped,
       CAST(coalesce(sum(c_total) FILTER (WHERE sampled), 0) AS BIGINT) AS candidates_total,
       CAST(coalesce(sum(c_parse) FILTER (WHERE sampled), 0) AS BIGINT) AS candidates_parse_ok,
       CAST(coalesce(sum(c_exec) FILTER (WHERE sampled), 0) AS BIGINT) AS candidates_execute_ok,
       CAST(coalesce(sum(c_match) FILTER (WHERE sampled), 0) AS BIGINT) AS candidates_match_gold
FROM j""")
def q_candidate_funnel(spark, sf):
    from ..operators.traces import candidate_funnel

    return candidate_funnel(_selection(spark, sf), V.candidates(spark, sf))


@register("drop_reasons", _selection_sql() + """
SELECT drop_reason, count(*) AS n FROM sel WHERE NOT kept GROUP BY drop_reason""")
def q_drop_reasons(spark, sf):
    from ..operators.traces import drop_reasons

    return drop_reasons(_selection(spark, sf))


# ==============================================================================================
# Dataset preparation: W4, W5, W6, F4, F5, P7, P9
# ==============================================================================================

def _docs(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", "text", "source", "lang", "n_chars")


@register("assign_mode", """
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents)
SELECT doc_id, CASE WHEN r <= (SELECT CAST(round_even(0.4 * n, 0) AS BIGINT) FROM n) THEN 'reasoning' ELSE 'direct' END AS mode
FROM r""")
def q_assign_mode(spark, sf):
    from ..operators.datasets import assign_modes

    return assign_modes(_docs(spark, sf).select("doc_id"), id_col="doc_id").select("doc_id", "mode")


@register("train_val_split", """
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents)
SELECT doc_id, CASE WHEN r <= (SELECT greatest(1, CAST(floor(n * 0.05) AS BIGINT)) FROM n) THEN 'val' ELSE 'train' END AS split
FROM r""")
def q_train_val_split(spark, sf):
    from ..operators.datasets import train_val_split

    return train_val_split(_docs(spark, sf).select("doc_id"), id_col="doc_id").select("doc_id", "split")


@register("length_batches", """
SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS position,
       (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch_id
FROM documents""")
def q_length_batches(spark, sf):
    from ..operators.datasets import length_batches

    return length_batches(_docs(spark, sf).select("doc_id", "n_chars"), "n_chars", 16, id_col="doc_id").select(
        "doc_id", "position", "batch_id")


_DOC_SCHEMA_BLOCK = "CREATE TABLE documents (\n  doc_id INTEGER PRIMARY KEY,\n  text TEXT\n);"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _user_prompt_sql(schema_block: str, question: str, mode: str) -> str:
    from ..functions.prompts import DIRECT_INSTRUCTION, REASONING_INSTRUCTION
    instr = f"CASE WHEN {mode} = 'reasoning' THEN {_sql_lit(REASONING_INSTRUCTION)} ELSE {_sql_lit(DIRECT_INSTRUCTION)} END"
    return (f"concat('### Schema (SQLite)' || chr(10), {schema_block}, chr(10) || chr(10) || '### Question' || chr(10), "
            f"{strip_sql(question)}, chr(10) || chr(10) || '### Instruction' || chr(10), {instr})")


def _length_filter_sql() -> str:
    from ..functions.prompts import SYSTEM_PROMPT
    user = _user_prompt_sql(_sql_lit(_DOC_SCHEMA_BLOCK), "source", "'direct'")
    text = f"concat_ws(chr(10) || chr(10), {_sql_lit(SYSTEM_PROMPT)}, {user}, text)"
    return f"""
WITH t AS (SELECT doc_id, CAST(floor(length({text}) / 4) AS BIGINT) AS n_tokens FROM documents)
SELECT doc_id, n_tokens, n_tokens <= 1024 AS keep FROM t"""


@register("length_filter", _length_filter_sql())
def q_length_filter(spark, sf):
    from ..functions.prompts import SYSTEM_PROMPT, user_prompt
    from ..operators.datasets import length_filter, training_text

    d = _docs(spark, sf)
    text = training_text(F.lit(SYSTEM_PROMPT), user_prompt(F.lit(_DOC_SCHEMA_BLOCK), "source", F.lit("direct")),
                         F.col("text"))
    return length_filter(d, text).select("doc_id", "n_tokens", "keep")


@register("direct_only", """
WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents)
SELECT doc_id, 'direct' AS mode FROM r WHERE r > (SELECT CAST(round_even(0.4 * n, 0) AS BIGINT) FROM n)""")
def q_direct_only(spark, sf):
    from ..operators.datasets import assign_modes, direct_only

    return direct_only(assign_modes(_docs(spark, sf).select("doc_id"), id_col="doc_id")).select("doc_id", "mode")


@register("user_prompts", with_views(["v_questions"], f"""
, n AS (SELECT count(*) AS n FROM v_questions)
, r AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || CAST(question_id AS VARCHAR)), question_id) AS r FROM v_questions)
, m AS (SELECT *, CASE WHEN r <= (SELECT CAST(round_even(0.4 * n, 0) AS BIGINT) FROM n) THEN 'reasoning' ELSE 'direct' END AS mode FROM r)
, p AS (SELECT question_id, mode, {_user_prompt_sql(_sql_lit(_DOC_SCHEMA_BLOCK), 'question', 'mode')} AS prompt FROM m)
SELECT question_id, mode, CASE WHEN mode = 'reasoning' THEN 512 ELSE 256 END AS max_tokens,
       CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5 FROM p"""))
def q_user_prompts(spark, sf):
    from ..functions.prompts import max_tokens_for, user_prompt
    from ..operators.datasets import assign_modes

    q = assign_modes(V.questions(spark, sf))
    p = q.select("question_id", "mode", max_tokens_for("mode").alias("max_tokens"),
                 user_prompt(F.lit(_DOC_SCHEMA_BLOCK), "question", "mode").alias("prompt"))
    return p.select("question_id", "mode", "max_tokens", F.length("prompt").cast("bigint").alias("prompt_chars"),
                    F.md5("prompt").alias("prompt_md5"))


def _chat_sql() -> str:
    from ..functions.prompts import SYSTEM_PROMPT
    rec = (f"concat('system: ', {_sql_lit(SYSTEM_PROMPT)}, chr(10), 'user: ', u.text, chr(10), "
           f"'assistant: ', a.text)")
    return f"""
SELECT u.conv_id, u.turn, 3 AS n_messages, md5({rec}) AS record_md5, CAST(length({rec}) AS BIGINT) AS record_chars
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


@register("chat_records", _chat_sql())
def q_chat_records(spark, sf):
    from ..functions.prompts import chat_messages

    c = V.read(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u_text"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("a_text"))
    pairs = u.join(a, on=["conv_id", "turn"])
    msgs = pairs.select("conv_id", "turn", chat_messages(F.col("u_text"), F.col("a_text")).alias("messages"))
    rec = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return msgs.select("conv_id", "turn", F.size("messages").alias("n_messages"), F.md5(rec).alias("record_md5"),
                       F.length(rec).cast("bigint").alias("record_chars"))


# ==============================================================================================
# Requests, response store, spend: P20-P22, J9, W7, F8, G8-G11, A10
# ==============================================================================================

_TEACHER_MODEL = "teacher-model"
_TEMPERATURE = 0.3
_CAP_USD = 0.005


def _requests(spark, sf):
    from ..functions.prompts import SYSTEM_PROMPT
    from ..operators.ledger import request_key

    c = V.read(spark, sf, "conversations").filter(F.col("role") == "user")
    msgs = F.concat(F.lit(SYSTEM_PROMPT + "\n"), F.col("text"))
    r = c.select("conv_id", "turn", msgs.alias("messages_text"),
                 F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_index"))
    return r.withColumn("key", request_key(F.lit(_TEACHER_MODEL), "messages_text", _TEMPERATURE, 256, "sample_index"))


def _requests_sql() -> str:
    from ..functions.prompts import SYSTEM_PROMPT
    return f"""
, req AS (
  SELECT u.conv_id, u.turn, {_sql_lit(SYSTEM_PROMPT + chr(10))} || u.text AS messages_text, s.sample_index,
         sha256(concat_ws(chr(31), '{_TEACHER_MODEL}', {_sql_lit(SYSTEM_PROMPT + chr(10))} || u.text, '{_TEMPERATURE:.4f}',
                          '256', CAST(s.sample_index AS VARCHAR))) AS key
  FROM conversations u CROSS JOIN (SELECT unnest(range(0, 3)) AS sample_index) s
  WHERE u.role = 'user')
, store AS (
  SELECT r.key, a.text, CAST(floor(length(r.messages_text) / 4) AS BIGINT) AS prompt_tokens,
         CAST(floor(length(a.text) / 4) AS BIGINT) AS completion_tokens
  FROM req r JOIN conversations a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant'
  WHERE r.sample_index = 0)
, replayed AS (
  SELECT r.*, s.key IS NOT NULL AS cached, coalesce(s.prompt_tokens, 0) AS prompt_tokens,
         coalesce(s.completion_tokens, 0) AS completion_tokens
  FROM req r LEFT JOIN store s ON s.key = r.key)"""


def _requests_with() -> str:
    """``WITH req, store, replayed`` (the CTE list above without its leading comma)."""
    return "WITH " + _requests_sql().lstrip().lstrip(",").lstrip()


def _store(spark, sf, req):
    return _store_rows(spark, sf, req).drop("conv_id")


def _store_rows(spark, sf, req):
    """Responses already stored: the assistant reply to sample 0 of each user turn."""
    c = V.read(spark, sf, "conversations").filter(F.col("role") == "assistant")
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    r0 = req.filter(F.col("sample_index") == 0).select("conv_id", "turn", "key", "messages_text")
    return r0.join(a, on=["conv_id", "turn"]).select(
        "conv_id", "key", "text", F.floor(F.length("messages_text") / 4).cast("bigint").alias("prompt_tokens"),
        F.floor(F.length("text") / 4).cast("bigint").alias("completion_tokens"))


@register("request_keys", _requests_with() + """
SELECT conv_id, turn, sample_index, key FROM req""")
def q_request_keys(spark, sf):
    return _requests(spark, sf).select("conv_id", "turn", F.col("sample_index").cast("bigint").alias("sample_index"),
                                       "key")


@register("cache_replay", _requests_with() + """
SELECT count(*) AS calls, CAST(count_if(cached) AS BIGINT) AS hits, CAST(count_if(NOT cached) AS BIGINT) AS misses
FROM replayed""")
def q_cache_replay(spark, sf):
    from ..operators.ledger import replay, replay_counts

    req = _requests(spark, sf)
    return replay_counts(replay(req, _store(spark, sf, req)))


@register("response_store", _requests_with() + """
, stored AS (
  SELECT r.key, r.conv_id AS saved, a.text, CAST(floor(length(r.messages_text) / 4) AS BIGINT) AS prompt_tokens,
         CAST(floor(length(a.text) / 4) AS BIGINT) AS completion_tokens
  FROM req r JOIN conversations a ON a.conv_id = r.conv_id AND a.turn = r.turn + 1 AND a.role = 'assistant'
  WHERE r.sample_index = 0)
, every AS (SELECT * FROM stored UNION ALL
            SELECT key, saved + 1000000000, 'again: ' || text, prompt_tokens, completion_tokens FROM stored WHERE saved % 2 = 0)
, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY saved DESC, text DESC, prompt_tokens DESC, completion_tokens DESC) AS r
           FROM every)
SELECT q.conv_id, q.turn, CAST(q.sample_index AS BIGINT) AS sample_index, s.key IS NOT NULL AS cached,
       md5(coalesce(s.text, '')) AS text_md5, coalesce(s.prompt_tokens, 0) AS prompt_tokens,
       coalesce(s.completion_tokens, 0) AS completion_tokens
FROM req q LEFT JOIN last s ON s.key = q.key AND s.r = 1""")
def q_response_store(spark, sf):
    """A9 + J9: three writes to the bucketed store (all, half of them again with a later answer, the first
    once more) and a replay of every request."""
    import uuid

    from ..session import cut_lineage, scratch_path
    from ..sources.store import open_store, replay_store, upsert_responses

    req = cut_lineage(_requests(spark, sf))
    name = f"responses_{uuid.uuid4().hex[:12]}"
    open_store(spark, name, scratch_path(spark, "responses"), buckets=8, prefix_chars=1)
    first = cut_lineage(_store_rows(spark, sf, req))
    again = first.where(F.col("conv_id") % 2 == 0).withColumns({
        "text": F.concat(F.lit("again: "), F.col("text")), "conv_id": F.col("conv_id") + 1_000_000_000})
    for rows in (first, again, first):
        upsert_responses(spark, name, rows.withColumn("saved_at", F.timestamp_seconds("conv_id")))
    return replay_store(spark, req, name).select(
        "conv_id", "turn", F.col("sample_index").cast("bigint").alias("sample_index"), "cached", F.md5("text").alias("text_md5"),
        "prompt_tokens", "completion_tokens")


@register("token_cost_per_1k", _requests_with() + f"""
SELECT '{_TEACHER_MODEL}' AS model, count(*) AS hits, round(avg(prompt_tokens), 6) AS avg_in_tokens,
       round(avg(completion_tokens), 6) AS avg_out_tokens,
       round(1000 * (avg(prompt_tokens) * 0.15 / 1000000 + avg(completion_tokens) * 0.60 / 1000000), 9) AS usd_per_1k
FROM replayed WHERE cached HAVING count(*) > 0""")
def q_token_cost_per_1k(spark, sf):
    from ..operators.ledger import cost_per_1k, replay

    req = _requests(spark, sf)
    r = replay(req, _store(spark, sf, req)).withColumn("model", F.lit(_TEACHER_MODEL))
    out = cost_per_1k(r)
    return out.select("model", "hits", F.round("avg_in_tokens", 6).alias("avg_in_tokens"),
                      F.round("avg_out_tokens", 6).alias("avg_out_tokens"),
                      F.round("usd_per_1k", 9).alias("usd_per_1k"))


@register("call_cost", with_views(["v_calls"], """
SELECT event_id, round(in_tokens * (0.15 / 1000000) + out_tokens * (0.60 / 1000000), 12) AS cost_usd,
       round(in_tokens * (0.15 / 1000000) + 256 * (0.60 / 1000000), 12) AS upper_bound_usd
FROM v_calls"""))
def q_call_cost(spark, sf):
    from ..operators.ledger import call_cost

    c = V.calls(spark, sf)
    return c.select("event_id", F.round(call_cost("in_tokens", "out_tokens"), 12).alias("cost_usd"),
                    F.round(call_cost("in_tokens", F.lit(256)), 12).alias("upper_bound_usd"))


@register("budget_gate", with_views(["v_calls"], f"""
, c AS (SELECT *, in_tokens * (0.15 / 1000000) + out_tokens * (0.60 / 1000000) AS cost FROM v_calls)
, s AS (SELECT event_id, ledger,
               coalesce(sum(cost) OVER (PARTITION BY ledger ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS spend_before,
               in_tokens * (0.15 / 1000000) + 256 * (0.60 / 1000000) AS estimate
        , ts FROM c)
, g AS (SELECT *, max(spend_before + estimate > {_CAP_USD}) OVER (PARTITION BY ledger ORDER BY ts, event_id
                                                                  ROWS UNBOUNDED PRECEDING) AS stopped FROM s)
SELECT event_id, ledger, NOT stopped AS allowed,
       round(CASE WHEN stopped THEN min(CASE WHEN stopped THEN spend_before END) OVER (PARTITION BY ledger)
                  ELSE spend_before END, 9) AS spend_before FROM g"""))
def q_budget_gate(spark, sf):
    from ..operators.ledger import budget_gate, call_cost, running_spend

    c = V.calls(spark, sf)
    s = budget_gate(running_spend(c, call_cost("in_tokens", "out_tokens")), call_cost("in_tokens", F.lit(256)), _CAP_USD)
    return s.select("event_id", "ledger", F.round("spend_before", 9).alias("spend_before"), "allowed")


@register("spend_ledger", with_views(["v_calls"], f"""
SELECT ledger, round(sum(in_tokens * (0.15 / 1000000) + out_tokens * (0.60 / 1000000)), 9) AS spend_usd,
       round(greatest(0.0, {_CAP_USD} - sum(in_tokens * (0.15 / 1000000) + out_tokens * (0.60 / 1000000))), 9) AS remaining_usd
FROM v_calls GROUP BY ledger"""))
def q_spend_ledger(spark, sf):
    from ..operators.ledger import call_cost, spend_summary

    s = spend_summary(V.calls(spark, sf), call_cost("in_tokens", "out_tokens"), _CAP_USD)
    return s.select("ledger", F.round("spend_usd", 9).alias("spend_usd"), F.round("remaining_usd", 9).alias("remaining_usd"))


@register("latency_summary", with_views(["v_calls"], """
, g AS (SELECT model, count(*) AS n, arg_min(seconds, (ts, event_id)) AS cold_s, arg_min(in_tokens, (ts, event_id)) AS cold_in,
               arg_min(out_tokens, (ts, event_id)) AS cold_out, sum(seconds) AS s, sum(in_tokens) AS i, sum(out_tokens) AS o,
               max(seconds) / 16 AS load_s
        FROM v_calls GROUP BY model)
SELECT model, n - 1 AS n_warm, round_even(load_s, 2) AS cold_load_s, round_even(cold_s, 3) AS cold_first_query_s,
       round_even(CASE WHEN n > 1 THEN (s - cold_s) / (n - 1) ELSE 0 END, 3) AS warm_s_per_query,
       round_even((o - cold_out) / greatest(s - cold_s, 0.001), 1) AS tokens_per_s,
       round_even(CASE WHEN n > 1 THEN (i - cold_in) / (n - 1) ELSE 0 END, 0) AS avg_in_tokens,
       round_even(CASE WHEN n > 1 THEN (o - cold_out) / (n - 1) ELSE 0 END, 0) AS avg_out_tokens
FROM g"""))
def q_latency_summary(spark, sf):
    """The load of a model, the call before all others, is given here as a sixteenth of its slowest call."""
    from ..operators.ledger import latency_summary

    c = V.calls(spark, sf)
    return latency_summary(c, loads=c.groupBy("model").agg((F.max("seconds") / 16).alias("load_s")))


# ==============================================================================================
# Run comparison: J4, J5, G6, W8, G13, A12, A14, J11, J12
# ==============================================================================================

def _disagreement_sql() -> str:
    cat = _category_sql("a.gold_sql", "a.pred_sql", "coalesce(a.failure_mode, '')")
    return with_views(["v_outcomes", "v_questions"], f"""
, a AS (SELECT * FROM v_outcomes WHERE run = 'student' AND NOT coalesce(exec_match, false))
, b AS (SELECT * FROM v_outcomes WHERE run = 'teacher' AND coalesce(exec_match, false))
, d AS (SELECT a.question_id, a.db_id, coalesce(a.difficulty, 'unknown') AS difficulty, a.gold_sql,
               a.pred_sql AS pred_a_sql, coalesce(a.failure_mode, '') AS pred_a_failure, b.pred_sql AS pred_b_sql,
               {cat} AS category, coalesce(q.question, '') AS question
        FROM a JOIN b ON b.question_id = a.question_id LEFT JOIN v_questions q ON q.question_id = a.question_id)""")


def _cases(spark, sf):
    from ..operators.compare import disagreements

    return disagreements(V.outcomes(spark, sf), "student", "teacher",
                         questions=V.questions(spark, sf).select("question_id", "question"))


@register("disagreements", _disagreement_sql() + "\nSELECT * FROM d")
def q_disagreements(spark, sf):
    return _cases(spark, sf)


@register("disagreement_categories", _disagreement_sql() + """
SELECT category, count(*) AS n, min(question_id) AS first_question_id FROM d GROUP BY category""")
def q_disagreement_categories(spark, sf):
    from ..operators.compare import category_counts

    return category_counts(_cases(spark, sf))


@register("case_examples", _disagreement_sql() + """
, per AS (SELECT category, count(*) AS n, min(question_id) AS qid FROM d GROUP BY category)
, ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, qid) AS shown FROM per)
SELECT r.shown, r.category, r.n, d.question_id, d.db_id, d.difficulty, d.question, d.gold_sql, d.pred_a_sql,
       d.pred_a_failure, d.pred_b_sql
FROM ranked r JOIN d ON d.category = r.category AND d.question_id = r.qid WHERE r.shown <= 12""")
def q_case_examples(spark, sf):
    from ..operators.compare import case_examples

    return case_examples(_cases(spark, sf), 12)


@register("fixed_regressed", with_views(["v_outcomes"], """
, base AS (SELECT question_id, coalesce(exec_match, false) AS base_ok FROM v_outcomes WHERE run = 'base')
, t AS (SELECT o.run, coalesce(o.exec_match, false) AS t_ok, b.base_ok FROM v_outcomes o
        JOIN base b ON b.question_id = o.question_id WHERE o.run <> 'base')
SELECT run AS treatment, CAST(count_if(NOT base_ok AND t_ok) AS BIGINT) AS fixed,
       CAST(count_if(base_ok AND NOT t_ok) AS BIGINT) AS regressed,
       CAST(count_if(NOT base_ok AND t_ok) AS BIGINT) - CAST(count_if(base_ok AND NOT t_ok) AS BIGINT) AS net
FROM t GROUP BY run"""))
def q_fixed_regressed(spark, sf):
    from ..operators.compare import fixed_regressed

    return fixed_regressed(V.outcomes(spark, sf), "base")


@register("change_categories", with_views(["v_outcomes"], f"""
, b AS (SELECT * FROM v_outcomes WHERE run = 'base')
, j AS (SELECT t.run AS treatment, t.question_id, coalesce(t.exec_match, false) AS t_ok,
               CASE WHEN t.exec_match THEN b.gold_sql ELSE t.gold_sql END AS gold_sql,
               CASE WHEN t.exec_match THEN b.pred_sql ELSE t.pred_sql END AS pred_sql,
               CASE WHEN t.exec_match THEN b.failure_mode ELSE t.failure_mode END AS failure
        FROM v_outcomes t JOIN b ON b.question_id = t.question_id
        WHERE t.run <> 'base' AND coalesce(t.exec_match, false) <> coalesce(b.exec_match, false))
SELECT treatment, CASE WHEN t_ok THEN 'fixed' ELSE 'regressed' END AS direction,
       {_category_sql('gold_sql', 'pred_sql', 'failure')} AS category, count(*) AS n, min(question_id) AS first_question_id
FROM j GROUP BY ALL"""))
def q_change_categories(spark, sf):
    from ..operators.compare import change_categories

    return change_categories(V.outcomes(spark, sf), "base")


@register("percent_board", with_views(["v_outcomes"], """
, g AS (SELECT run, count_if(exec_match) / count(*) AS exec_accuracy, """ + ", ".join(
    f"CASE WHEN count_if(difficulty = '{b}') > 0 THEN count_if(difficulty = '{b}' AND exec_match) / "
    f"count_if(difficulty = '{b}') ELSE 0.0 END AS {b}" for b in st.DIFFICULTY_BUCKETS) + """
        FROM v_outcomes GROUP BY run)
SELECT run, run AS label, """ + ", ".join(
    f"printf('%.1f', round_even(100 * round({c}, 6), 1)) || '%' AS {c}" for c in ("exec_accuracy", *st.DIFFICULTY_BUCKETS)) + """
FROM g"""))
def q_percent_board(spark, sf):
    return ev.percent_board(ev.leaderboard(V.outcomes(spark, sf)))


_SUMMARY_SQL = """
SELECT run, CASE WHEN grouping(difficulty) = 1 THEN 'all' ELSE difficulty END AS difficulty, count(*) AS n,
       round(sum(CAST(exec_match AS INTEGER)) / count(*), 6) AS exec_accuracy,
       round(sum(CAST(exact_set_match AS INTEGER)) / count(*), 6) AS exact_match_accuracy
FROM v_outcomes WHERE run IN {runs} GROUP BY GROUPING SETS ((run), (run, difficulty))"""


@register("merge_runs", with_views(["v_outcomes"], f"""
, existing AS ({_SUMMARY_SQL.format(runs="('base', 'student')")})
, new AS ({_SUMMARY_SQL.format(runs="('student', 'teacher')")})
SELECT *, 'existing' AS source FROM existing WHERE run NOT IN (SELECT run FROM new)
UNION ALL SELECT *, 'new' AS source FROM new"""))
def q_merge_runs(spark, sf):
    from ..operators.compare import merge_runs

    o = V.outcomes(spark, sf)
    existing = ev.summarize(o.filter(F.col("run").isin("base", "student"))).withColumn("source", F.lit("existing"))
    new = ev.summarize(o.filter(F.col("run").isin("student", "teacher"))).withColumn("source", F.lit("new"))
    return merge_runs(existing, new)


def _printout_sql() -> str:
    buckets = ("easy", "medium", "hard", "extra", "all")

    def cell(metric, b):
        return (f"printf('%.3f', round_even(coalesce(first({metric}) FILTER (WHERE difficulty = '{b}'), 0.0), 3))")
    ex = ", ".join(cell("exec_accuracy", b) for b in buckets)
    em = ", ".join(cell("exact_match_accuracy", b) for b in buckets)
    return f"""
, summ AS ({_SUMMARY_SQL.format(runs="('base', 'student', 'teacher')")})
, per AS (SELECT run, concat_ws('     ', 'execution         ', {ex}) AS ex,
                 concat_ws('     ', 'exact match       ', {em}) AS em FROM summ GROUP BY run)
, lines AS (SELECT run, 1 AS line_no, ex AS value FROM per UNION ALL SELECT run, 2, em FROM per)
, parsed AS (
  SELECT run, regexp_extract(value, '{ev.EVAL_LINE_RE}', 1) AS metric,
         {", ".join(f"CAST(regexp_extract(value, '{ev.EVAL_LINE_RE}', {i + 2}) AS DOUBLE) AS {b}" for i, b in enumerate(buckets))}
  FROM lines)
, official AS (UNPIVOT parsed ON easy, medium, hard, extra, "all" INTO NAME bucket VALUE value)"""


@register("eval_printout", with_views(["v_outcomes"], _printout_sql() + """
SELECT run, metric, bucket, value FROM official"""))
def q_eval_printout(spark, sf):
    s = ev.summarize(V.outcomes(spark, sf))
    return ev.parse_evaluator_printout(ev.evaluator_printout(s), pos_col="line_no")


@register("overlay_metrics", with_views(["v_outcomes"], _printout_sql() + """
SELECT s.run, s.difficulty, s.exec_accuracy, o.value AS official_exec, coalesce(o.value, s.exec_accuracy) AS exec_overlay
FROM summ s LEFT JOIN official o ON o.run = s.run AND o.bucket = s.difficulty AND o.metric = 'execution'"""))
def q_overlay_metrics(spark, sf):
    s = ev.summarize(V.outcomes(spark, sf))
    off = ev.parse_evaluator_printout(ev.evaluator_printout(s), pos_col="line_no")
    return ev.overlay_metrics(s, off).select("run", "difficulty", "exec_accuracy", "official_exec", "exec_overlay")


_AXIS = [("Base 0.5B", "base", 0.5), ("Student 1.5B", "student", 1.5), ("Teacher", "teacher", 7.0),
         ("Student 3B", "student_3b", 3.0)]


@register("scaling_axis", with_views(["v_outcomes"], f"""
, summ AS ({_SUMMARY_SQL.format(runs="('base', 'student', 'teacher')")})
, axis(label, run, size) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in _AXIS)})
SELECT a.run, a.label, a.size, CASE WHEN s.exec_accuracy IS NULL THEN 'NaN'
            ELSE printf('%.1f', round_even(s.exec_accuracy * 100.0, 1)) END AS exec_pct
FROM axis a LEFT JOIN summ s ON s.run = a.run AND s.difficulty = 'all'"""))
def q_scaling_axis(spark, sf):
    from ..operators.compare import scaling_axis

    axis = spark.createDataFrame(_AXIS, "label string, run string, size double")
    return scaling_axis(axis, ev.summarize(V.outcomes(spark, sf))).select("run", "label", "size", "exec_pct")


# ==============================================================================================
# Catalog and schema text: A1, A2, A13, A16, J7, J8, G14, P1-P5
# ==============================================================================================

def _raw_catalog_roundtrip(spark, sf):
    """A1 read path: the catalog is written as compressed JSON lines to the shared scratch folder and read
    back with the explicit catalog schema."""
    from ..session import scratch_path, spread
    from ..sources.catalog import read_raw_catalog

    path = scratch_path(spark, "catalog")
    V.raw_catalog(spark, sf).write.mode("overwrite").json(path, compression="gzip")
    return spread(read_raw_catalog(spark, path))  # a compressed file is one split


def _qi_sql(n: str) -> str:
    from ..functions.ddl import BARE_IDENT_RE
    return (f"CASE WHEN {n} = '' THEN '\"\"' WHEN starts_with({n}, '\"') AND ends_with({n}, '\"') THEN {n} "
            f"WHEN regexp_matches({n}, '{BARE_IDENT_RE}') THEN {n} "
            f"ELSE '\"' || replace({n}, '\"', '\"\"') || '\"' END")


@register("schema_catalog", with_views(["v_raw_catalog"], """
, cc AS (SELECT unnest([0, 1, 2]) AS c)
SELECT db_id, CAST(table_index AS INTEGER) AS table_index, tab.tname AS table_name,
       CAST(1 + 3 * table_index + c AS BIGINT) AS flat_index,
       CASE c WHEN 0 THEN tab.c0 WHEN 1 THEN tab.c1 ELSE 'flag' END AS column_name,
       CASE c WHEN 2 THEN tab.ty2 ELSE 'number' END AS column_type, c = 0 AS is_primary
FROM v_cat_flat, cc"""))
def q_schema_catalog(spark, sf):
    from ..sources.catalog import catalog_columns

    return catalog_columns(_raw_catalog_roundtrip(spark, sf))


@register("fk_resolved", with_views(["v_raw_catalog"], """
SELECT db_id, CAST(table_index AS BIGINT) AS pos, CAST(table_index AS INTEGER) AS from_table, tab.c1 AS from_column,
       0 AS to_table, tabs[1].c0 AS to_column, tabs[1].tname AS to_table_name
FROM v_cat_flat WHERE table_index >= 1"""))
def q_fk_resolved(spark, sf):
    from ..sources.catalog import catalog_fks

    return catalog_fks(_raw_catalog_roundtrip(spark, sf))


def _ddl_sql() -> str:
    t2 = "CASE WHEN tab.ty2 = '' THEN 'TEXT' ELSE upper(tab.ty2) END"
    lines = (f"['  ' || {_qi_sql('tab.c0')} || ' NUMBER PRIMARY KEY', '  ' || {_qi_sql('tab.c1')} || ' NUMBER', "
             f"'  flag ' || {t2}]")
    fk = (f"CASE WHEN table_index >= 1 THEN ['  FOREIGN KEY (' || {_qi_sql('tab.c1')} || ') REFERENCES ' || "
          f"{_qi_sql('tabs[1].tname')} || '(' || {_qi_sql('tabs[1].c0')} || ')'] ELSE CAST([] AS VARCHAR[]) END")
    return with_views(["v_raw_catalog"], f"""
SELECT db_id, CAST(table_index AS INTEGER) AS table_index,
       'CREATE TABLE ' || {_qi_sql('tab.tname')} || ' (' || chr(10) ||
       array_to_string(list_concat({lines}, {fk}), ',' || chr(10)) || chr(10) || ');' AS ddl
FROM v_cat_flat""")


@register("table_ddl", _ddl_sql())
def q_table_ddl(spark, sf):
    from ..functions.ddl import column_line, create_table, fk_line
    from ..sources.catalog import catalog_table_lists

    t = catalog_table_lists(_raw_catalog_roundtrip(spark, sf)).where(F.size("columns") > 0)
    ddl = create_table("table_name",
                       F.transform("columns", lambda c: column_line(c["column_name"], c["column_type"], c["is_primary"])),
                       F.transform("fks", lambda f: fk_line(f["from_column"], f["to_table_name"], f["to_column"])))
    return t.select("db_id", "table_index", ddl.alias("ddl"))


_BLOCK_BUDGET = 620


def _schema_blocks_sql() -> str:
    t2 = "CASE WHEN tab.ty2 = '' THEN 'TEXT' ELSE upper(tab.ty2) END"
    lines = (f"['  ' || {_qi_sql('tab.c0')} || ' NUMBER PRIMARY KEY', '  ' || {_qi_sql('tab.c1')} || ' NUMBER', "
             f"'  flag ' || {t2}]")
    fk = (f"CASE WHEN table_index >= 1 THEN ['  FOREIGN KEY (' || {_qi_sql('tab.c1')} || ') REFERENCES ' || "
          f"{_qi_sql('tabs[1].tname')} || '(' || {_qi_sql('tabs[1].c0')} || ')'] ELSE CAST([] AS VARCHAR[]) END")
    cells = ("CAST(tab.b AS VARCHAR)", "CAST(tab.c AS VARCHAR)", "'row ' || CAST(tab.a AS VARCHAR)")
    heads = ("tab.c0", "tab.c1", "'flag'")
    pad = lambda v, i: f"rpad({v}, CAST(greatest(length({heads[i]}), length({cells[i]})) AS INTEGER), ' ')"
    head, row = (" || '  ' || ".join(pad(v, i) for i, v in enumerate(vs)) for vs in (heads, cells))
    sample = " || ' ' || ".join(cells)
    return with_views(["v_raw_catalog"], f"""
, rendered AS (
  SELECT db_id, table_index, 'CREATE TABLE ' || {_qi_sql('tab.tname')} || ' (' || chr(10) ||
         array_to_string(list_concat({lines}, {fk}), ',' || chr(10)) || chr(10) || ');' AS ddl,
         '/* sample rows:' || chr(10) || '  ' || {head} || chr(10) || '  ' || {row} || chr(10) || '*/' AS block,
         {sample} AS sample, tab.tname || ' ' || tab.c0 || ' ' || tab.c1 || ' flag ' || {sample} AS text
  FROM v_cat_flat)
, v_corpus AS (SELECT db_id, table_index, text FROM rendered)
, sizes AS (SELECT db_id, count(*) AS n, sum(length(ddl) + length(sample)) + 2 * (2 * count(*) - 1) AS full_chars
            FROM rendered GROUP BY db_id)
, asked AS (SELECT l_orderkey AS question_id, 'ord' || CAST(l_orderkey AS VARCHAR) AS db_id,
                   'which part_' || CAST(tabs[len(tabs)].b AS VARCHAR) || ' has the flag' AS question FROM v_cat_tabs)
, v_questions AS (SELECT a.* FROM asked a JOIN sizes USING (db_id) WHERE full_chars > {_BLOCK_BUDGET})
""" + _bm25_sql_ctes() + _topk_sql(2) + """
, seeds AS (SELECT question_id, db_id, list(table_index) AS seed FROM ranked WHERE rank <= 2 GROUP BY ALL)
, closed AS (SELECT question_id, s.db_id, list_sort(list_reduce(range(1, n), lambda acc, t:
                    CASE WHEN list_contains(acc, t) OR list_contains(acc, 0) THEN list_distinct(list_concat(acc, [t, 0])) ELSE acc END,
                    seed)) AS kept FROM seeds s JOIN sizes z ON z.db_id = s.db_id)
, chosen AS (SELECT a.question_id, a.db_id, z.full_chars <= """ + str(_BLOCK_BUDGET) + """ AS whole,
                    CASE WHEN z.full_chars <= """ + str(_BLOCK_BUDGET) + """ THEN range(0, z.n) ELSE c.kept END AS kept
             FROM asked a JOIN sizes z ON z.db_id = a.db_id LEFT JOIN closed c ON c.question_id = a.question_id)
SELECT c.question_id, any_value(c.whole) AS whole, CAST(count(*) AS BIGINT) AS n_tables,
       CAST(sum(length(r.ddl) + length(r.sample) - CASE WHEN NOT list_contains(c.kept, 0) AND r.table_index >= 1
                     THEN len(string_split(r.ddl, chr(10))[-2]) + 2 ELSE 0 END) + 2 * (2 * count(*) - 1) AS BIGINT) AS chars,
       md5(string_agg(r.ddl || chr(10) || chr(10) || r.block, chr(10) || chr(10) ORDER BY r.table_index)) AS block_md5
FROM chosen c JOIN rendered r ON r.db_id = c.db_id AND list_contains(c.kept, r.table_index)
GROUP BY c.question_id""")


@register("schema_blocks", _schema_blocks_sql())
def q_schema_blocks(spark, sf):
    """Catalog -> DDL and sample rows -> choice sized by rendered text -> the block of every question."""
    from ..operators.schema_blocks import schema_blocks

    li = V.read(spark, sf, "lineitem")
    at = F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"),
                  F.col("l_extendedprice").alias("d"), F.col("l_shipdate").alias("e"))
    tabs = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(at)).alias("tabs"))
    db = F.concat(F.lit("ord"), _s("l_orderkey"))
    asked = tabs.select(F.col("l_orderkey").alias("question_id"), db.alias("db_id"), F.concat(
        F.lit("which part_"), F.element_at("tabs", -1)["b"].cast("string"), F.lit(" has the flag")).alias("question"))
    flat = tabs.select(db.alias("db_id"), F.posexplode("tabs").alias("table_index", "t"))
    samples = flat.select("db_id", "table_index", F.array(F.array(
        _s("t.b"), _s("t.c"), F.concat(F.lit("row "), _s("t.a")))).alias("rows"))
    out = schema_blocks(_raw_catalog_roundtrip(spark, sf), asked, samples, budget_chars=_BLOCK_BUDGET)
    return out.select("question_id", "whole", F.size("tables").cast("bigint").alias("n_tables"), "chars",
                      F.md5("schema_block").alias("block_md5"))


@register("quote_ident", f"""
SELECT p_partkey, {_qi_sql('p_name')} AS q_name, {_qi_sql('p_brand')} AS q_brand, {_qi_sql('p_type')} AS q_type,
       {_qi_sql("replace(p_type, ' ', '_')")} AS q_type_snake FROM part""")
def q_quote_ident(spark, sf):
    from ..functions.ddl import quote_ident

    p = V.read(spark, sf, "part")
    return p.select("p_partkey", quote_ident("p_name").alias("q_name"), quote_ident("p_brand").alias("q_brand"),
                    quote_ident("p_type").alias("q_type"),
                    quote_ident(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("q_type_snake"))


def _cell_sql(x: str, n: int) -> str:
    s = f"replace(replace(CAST({x} AS VARCHAR), chr(10), ' '), chr(9), ' ')"
    return (f"CASE WHEN {x} IS NULL THEN 'NULL' WHEN length({s}) > {n} THEN substr({s}, 1, {n - 1}) || '…' "
            f"ELSE {s} END")


@register("cell_text", f"""
SELECT page_id, {_cell_sql('html', 40)} AS html_cell, {_cell_sql('url', 40)} AS url_cell FROM pages""")
def q_cell_text(spark, sf):
    from ..functions.ddl import cell_text

    p = V.read(spark, sf, "pages")
    return p.select("page_id", cell_text("html", 40).alias("html_cell"), cell_text("url", 40).alias("url_cell"))


_SAMPLE_TRUNC = 12
_SAMPLE_HEADERS = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def _sample_block_sql() -> str:
    cells = [_cell_sql("c_custkey", _SAMPLE_TRUNC), _cell_sql("c_name", _SAMPLE_TRUNC),
             _cell_sql("CAST(c_acctbal AS DECIMAL(12, 2))", _SAMPLE_TRUNC), _cell_sql("c_mktsegment", _SAMPLE_TRUNC)]
    sel = ", ".join(f"{c} AS v{i}" for i, c in enumerate(cells))
    widths = ", ".join(f"greatest({len(h)}, max(length(v{i}))) AS w{i}" for i, h in enumerate(_SAMPLE_HEADERS))
    line = " || '  ' || ".join(f"rpad(v{i}, CAST(w{i} AS INTEGER), ' ')" for i in range(4))
    head = " || '  ' || ".join(f"rpad('{h}', CAST(w{i} AS INTEGER), ' ')" for i, h in enumerate(_SAMPLE_HEADERS))
    return f"""
WITH r AS (SELECT c_nationkey, c_custkey, {sel},
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer),
top AS (SELECT * FROM r WHERE rn <= 3),
w AS (SELECT c_nationkey, {widths} FROM top GROUP BY c_nationkey),
lines AS (SELECT t.c_nationkey, t.rn, '  ' || {line} AS line, '  ' || {head} AS head
          FROM top t JOIN w ON w.c_nationkey = t.c_nationkey)
SELECT c_nationkey AS nation_key,
       '/* sample rows:' || chr(10) || any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY rn) || chr(10) || '*/' AS block
FROM lines GROUP BY c_nationkey"""


@register("sample_row_block", _sample_block_sql())
def q_sample_row_block(spark, sf):
    from ..functions.ddl import sample_rows_block
    from ..sources.catalog import sample_rows

    c = V.read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name",
                                             F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"), "c_mktsegment")
    rows = sample_rows(c, ["c_custkey"], n=3, cell_truncate=_SAMPLE_TRUNC, group_cols=["c_nationkey"])
    per = rows.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("__r", "cells"))).alias("rs"))
    headers = F.array(*[F.lit(h) for h in _SAMPLE_HEADERS])
    return per.select(F.col("c_nationkey").alias("nation_key"),
                      sample_rows_block(headers, F.transform("rs", lambda x: x["cells"])).alias("block"))


@register("corpus_check", """
WITH ex AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS db_id FROM orders),
sch AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS db_id FROM customer),
dat AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS db_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
d AS (SELECT DISTINCT db_id FROM ex)
SELECT (SELECT count(*) FROM ex) AS n_examples, (SELECT count(*) FROM d) AS n_dbs,
       (SELECT count(*) FROM d WHERE db_id NOT IN (SELECT db_id FROM sch)) AS n_dbs_without_schema,
       (SELECT count(*) FROM d WHERE db_id NOT IN (SELECT db_id FROM dat)) AS n_dbs_without_data,
       (SELECT count(*) FROM ex WHERE db_id IN (SELECT db_id FROM sch)) AS n_examples_with_schema""")
def q_corpus_check(spark, sf):
    from ..sources.catalog import corpus_check

    o = V.read(spark, sf, "orders")
    ex = o.select(F.concat(F.lit("c"), _s("o_custkey")).alias("db_id"))
    sch = V.read(spark, sf, "customer").select(F.concat(F.lit("c"), _s("c_custkey")).alias("db_id"))
    li = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    dat = o.join(li, on="o_orderkey", how="left_semi").select(F.concat(F.lit("c"), _s("o_custkey")).alias("db_id"))
    return corpus_check(ex, sch, dat)


def _s(c):
    return F.col(c).cast("string")


# ==============================================================================================
# Statement execution and scoring: X1, X3, X4, F2, F3
# ==============================================================================================

def _register_tpch(spark, sf):
    from .sql_pairs import TPCH_TABLES

    for t in TPCH_TABLES:  # statements read the tables as stored (no helper repartition)
        spark.read.parquet(f"{sf.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)


def _pairs_df(spark):
    from .sql_pairs import PAIRS

    return spark.createDataFrame([(p[0], p[1], p[2]) for p in PAIRS], "pair_id long, gold_sql string, pred_sql string")


def _pairs_oracle(count_rows: bool) -> str:
    from .sql_pairs import PAIRS

    def clean(s):
        return s.strip().rstrip(";").strip()
    parts = []
    for pid, gold, pred, kind, _ in PAIRS:
        g, p = clean(gold), clean(pred)
        if kind == "cmp":
            m = (f"((SELECT count(*) FROM (SELECT * FROM ({g}) EXCEPT ALL SELECT * FROM ({p}))) = 0 AND "
                 f"(SELECT count(*) FROM (SELECT * FROM ({p}) EXCEPT ALL SELECT * FROM ({g}))) = 0)")
            pst = "'ok'"
        else:
            m, pst = "false", f"'{kind}'"
        fm = f"CASE WHEN {m} THEN 'ok' WHEN {pst} = 'empty' THEN 'empty' WHEN {pst} = 'parse' THEN 'parse' " \
             f"WHEN {pst} = 'execution' THEN 'execution' ELSE 'wrong-result' END"
        if count_rows:
            parts.append(f"SELECT sha256({_sql_lit(g)}) AS stmt_id, 'ok' AS status, "
                         f"(SELECT count(*) FROM ({g})) AS n_rows")
            if kind == "cmp":
                parts.append(f"SELECT sha256({_sql_lit(p)}), 'ok', (SELECT count(*) FROM ({p}))")
            else:
                parts.append(f"SELECT sha256({_sql_lit(p)}), '{kind}', 0")
        else:
            parts.append(f"SELECT CAST({pid} AS BIGINT) AS pair_id, 'ok' AS gold_status, {pst} AS pred_status, "
                         f"{m} AS exec_match, {fm} AS failure_mode")
    body = "\nUNION ALL ".join(parts)
    if count_rows:
        return f"SELECT DISTINCT * FROM ({body})"
    return body


@register("run_statements", _pairs_oracle(True))
def q_run_statements(spark, sf):
    from ..operators.execute import run_statements

    _register_tpch(spark, sf)
    p = _pairs_df(spark)
    stmts = p.select(F.col("gold_sql").alias("sql")).unionByName(p.select(F.col("pred_sql").alias("sql")))
    status, rows = run_statements(spark, stmts)
    counts = rows.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return status.join(counts, "stmt_id", "left").select(
        "stmt_id", "status", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


@register("score_sql_pairs", _pairs_oracle(False))
def q_score_sql_pairs(spark, sf):
    from ..operators.execute import score_pairs

    _register_tpch(spark, sf)
    return score_pairs(spark, _pairs_df(spark))


STATEMENT_KINDS = {
    0: "SELECT s_name, s_acctbal FROM supplier WHERE s_suppkey BETWEEN {lo} AND {hi}",
    1: "SELECT n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey "
       "WHERE s_suppkey >= {lo} AND s_suppkey <= {hi} GROUP BY n_name",
    2: "SELECT s_title FROM supplier WHERE s_suppkey = {lo}",
    3: "SELECT (s_name FROM supplier WHERE s_suppkey = {lo}",
    4: "SELECT reflect('java.lang.Math', 'abs', {lo})",
    5: "DELETE FROM supplier WHERE s_suppkey = {lo}",
    6: "SELECT * FROM parquet.`/somewhere/{lo}`",
}


@register("statement_batches", """
WITH b AS (SELECT s_suppkey // 8 AS block, min(s_suppkey) AS lo, max(s_suppkey) AS hi, count(*) AS n,
                  count(DISTINCT s_nationkey) AS nations FROM supplier GROUP BY 1)
SELECT CAST(block AS BIGINT) AS block,
       CASE WHEN block % 7 IN (0, 1) THEN 'ok' WHEN block % 7 = 3 THEN 'parse' ELSE 'execution' END AS status,
       CAST(CASE block % 7 WHEN 0 THEN n WHEN 1 THEN nations ELSE 0 END AS BIGINT) AS n_rows
FROM b""")
def q_statement_batches(spark, sf):
    """X1 over a list of statements that grows with the data, in two calls that share a work folder."""
    from ..operators.execute import run_statements, statement_id
    from ..session import scratch_path

    _register_tpch(spark, sf)
    b = V.read(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 8).alias("block")).agg(
        F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))
    text = F.lit(None).cast("string")
    for kind, form in STATEMENT_KINDS.items():
        parts = F.replace(F.replace(F.lit(form), F.lit("{lo}"), _s("lo")), F.lit("{hi}"), _s("hi"))
        text = F.when(F.col("block") % 7 == kind, parts).otherwise(text)
    stmts = b.select("block", text.alias("sql"))
    work = scratch_path(spark, "statement-batches")
    run_statements(spark, stmts, work=work, batch_size=16, max_batches=1)
    status, rows = run_statements(spark, stmts, work=work, batch_size=16)
    counts = rows.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return stmts.withColumn("stmt_id", statement_id("sql")).join(status, "stmt_id").join(counts, "stmt_id", "left").select(
        "block", "status", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"))


# ==============================================================================================
# Prediction plumbing: J1, J2, J3, A8, U1
# ==============================================================================================

def _examples(spark, sf):
    o = V.outcomes(spark, sf).filter(F.col("run") == "student")
    return o.select("question_id", "db_id", F.col("gold_sql").alias("query"),
                    F.concat(F.lit("question "), _s("question_id")).alias("question"))


@register("predict_join", with_views(["v_outcomes"], f"""
, ex AS (SELECT question_id, 'c' || CAST(o_custkey AS VARCHAR) AS db_id, gold_sql AS query
         FROM v_outcomes o JOIN orders ON o_orderkey = question_id WHERE run = 'student')
, preds AS (SELECT question_id, pred_sql AS predicted_sql FROM v_outcomes WHERE run = 'student' AND pred_sql <> '')
, sch AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS db_id FROM customer WHERE c_acctbal >= 0)
, j AS (SELECT e.question_id, e.db_id, e.query, coalesce(p.predicted_sql, '') AS predicted_sql,
               s.db_id IS NOT NULL AS has_schema
        FROM ex e LEFT JOIN preds p ON p.question_id = e.question_id LEFT JOIN sch s ON s.db_id = e.db_id)
SELECT question_id, has_schema, predicted_sql,
       CASE WHEN replace(replace({strip_sql('predicted_sql')}, chr(10), ' '), chr(13), ' ') = '' THEN 'SELECT 1'
            ELSE replace(replace({strip_sql('predicted_sql')}, chr(10), ' '), chr(13), ' ') END AS pred_line,
       replace({strip_sql('query')}, chr(10), ' ') || chr(9) || db_id AS gold_line
FROM j"""))
def q_predict_join(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"),
                                           F.concat(F.lit("c"), _s("o_custkey")).alias("db_id"))
    ex = _examples(spark, sf).drop("db_id").join(o, "question_id")
    preds = V.outcomes(spark, sf).filter((F.col("run") == "student") & (F.col("pred_sql") != "")).select(
        "question_id", F.col("pred_sql").alias("predicted_sql"))
    cust = V.read(spark, sf, "customer")
    # Databases of customers with a negative balance have no schema in this fixture (J2 misses).
    sch = cust.filter(F.col("c_acctbal") >= 0).select(F.concat(F.lit("c"), _s("c_custkey")).alias("db_id"))
    j = ev.attach_schemas(ev.attach_outputs(ex, preds), sch)
    lines = ev.evaluator_pred_lines(j).withColumnRenamed("line", "pred_line")
    gold = ev.evaluator_gold_lines(j).withColumnRenamed("line", "gold_line")
    return j.select("question_id", "has_schema", "predicted_sql").join(lines, "question_id").join(gold, "question_id")


@register("evaluator_files", with_views(["v_outcomes"], f"""
, j AS (SELECT question_id, 'c' || CAST(o_custkey AS VARCHAR) AS db_id, gold_sql AS query, pred_sql AS predicted_sql
        FROM v_outcomes o JOIN orders ON o_orderkey = question_id WHERE run = 'student')
SELECT row_number() OVER (ORDER BY question_id) AS line_no,
       CASE WHEN replace(replace({strip_sql('predicted_sql')}, chr(10), ' '), chr(13), ' ') = '' THEN 'SELECT 1'
            ELSE replace(replace({strip_sql('predicted_sql')}, chr(10), ' '), chr(13), ' ') END AS pred_line,
       replace({strip_sql('query')}, chr(10), ' ') AS gold_sql, db_id
FROM j"""))
def q_evaluator_files(spark, sf):
    """Both files written in parts, committed, and paired again by line number."""
    from ..session import scratch_path

    orders = V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"),
                                                F.concat(F.lit("c"), _s("o_custkey")).alias("db_id"))
    rows = V.outcomes(spark, sf).filter(F.col("run") == "student").select(
        "question_id", F.col("gold_sql").alias("query"), F.col("pred_sql").alias("predicted_sql")).join(orders, "question_id")
    path = scratch_path(spark, "evaluator-files")
    ev.write_evaluator_files(rows, path, rows_per_file=20_000)
    return ev.read_evaluator_files(spark, path)


ARRAY_ROWS = 2000


@register("example_arrays", f"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
SELECT n // {ARRAY_ROWS} AS part, n % {ARRAY_ROWS} AS question_id, source AS db_id, md5(coalesce(text, '')) AS question_md5,
       'SELECT "}}{{" FROM t WHERE x = ' || CAST(doc_id AS VARCHAR) AS query
FROM d""")
def q_example_arrays(spark, sf):
    """A3: documents as the questions of JSON arrays, one array a file, read back in splits with their positions."""
    from ..operators.ranking import exact_rank
    from ..session import scratch_path
    from ..sources.catalog import EXAMPLE_SCHEMA
    from ..sources.lines import array_elements

    docs = exact_rank(V.read(spark, sf, "documents").select("doc_id", "source", "text"), ["doc_id"], "__n").withColumn(
        "__n", F.col("__n") - 1)
    parts = docs.select(F.floor(F.col("__n") / ARRAY_ROWS).cast("long").alias("part"), "__n", "doc_id", F.struct(
        F.struct(F.lit("}").alias("brace"), F.array(F.lit("]")).alias("list")).alias("extra"), F.col("source").alias("db_id"),
        F.coalesce("text", F.lit("")).alias("question"),
        F.concat(F.lit('SELECT "}{" FROM t WHERE x = '), _s("doc_id")).alias("query")).alias("__x"))
    last = docs.agg(F.max("__n")).first()[0]
    path = scratch_path(spark, "example-arrays")
    head = F.when(F.col("__n") % ARRAY_ROWS == 0, "[").otherwise(", ")
    tail = F.when((F.col("__n") % ARRAY_ROWS == ARRAY_ROWS - 1) | (F.col("__n") == F.lit(last)), "]").otherwise("")
    parts.repartition("part").sortWithinPartitions("part", "__n").select(
        "part", F.concat(head, F.to_json("__x"), tail).alias("value")).write.partitionBy("part").text(path)
    rows = array_elements(spark, path).select(
        F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("long").alias("part"), F.col("position").alias("question_id"),
        F.from_json("element", EXAMPLE_SCHEMA).alias("x"))
    return rows.select("part", "question_id", "x.db_id", F.md5("x.question").alias("question_md5"), "x.query")


@register("predictor_baselines", """
WITH q AS (SELECT item_id FROM benchmark)
SELECT 'gold' AS run, count(*) AS n, 1.0 AS exec_accuracy, CAST(0 AS BIGINT) AS n_empty FROM q
UNION ALL SELECT 'empty', count(*), 0.0, count(*) FROM q""")
def q_predictor_baselines(spark, sf):
    """The gold and empty predictors scored end to end (statements executed on Spark)."""
    from ..operators.execute import score_pairs

    spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet").createOrReplaceTempView("documents")
    ex = V.questions(spark, sf)
    parts = []
    for name, pred in (("gold", ev.predict_gold(ex)), ("empty", ev.predict_empty(ex))):
        j = ev.join_predictions(pred, ex)
        parts.append(j.select(F.concat(F.lit(name + ":"), _s("question_id")).alias("pair_id"), "gold_sql",
                              F.col("predicted_sql").alias("pred_sql"), F.lit(name).alias("run")))
    pairs = parts[0].unionByName(parts[1])
    # One scoring pass for both runs: every distinct statement executes once.
    scored = score_pairs(spark, pairs.drop("run")).join(pairs.select("pair_id", "run"), "pair_id")
    allr = scored
    return allr.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("exec_match").cast("double")).alias("exec_accuracy"),
        F.count_if(F.col("failure_mode") == "empty").alias("n_empty"),
    )


# ==============================================================================================
# Streams: R1, R2 (availableNow over responses landed as files; checked against batch SQL)
# ==============================================================================================

def _landing(spark, sf):
    """Completions as landed responses; every tenth response is delivered twice."""
    from ..session import scratch_path
    from ..streaming.traces import write_landing

    c = V.completions(spark, sf).join(_docs(spark, sf).select("doc_id", "n_chars"), "doc_id")
    resp = c.select(F.concat(F.lit("doc"), _s("doc_id")).alias("key"), "text",
                    F.floor(F.col("n_chars") / 4).cast("bigint").alias("prompt_tokens"),
                    (F.col("doc_id") % 50).cast("bigint").alias("completion_tokens"),
                    F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("saved_at"),
                    F.col("doc_id"))
    resp = resp.unionByName(resp.filter(F.col("doc_id") % 10 == 0)).drop("doc_id")
    path = scratch_path(spark, "landing")
    write_landing(resp, path, n_files=8)
    return path


@register("stream_trace_build", with_views(["v_completions"], f"""
SELECT 'doc' || CAST(c.doc_id AS VARCHAR) AS key, c.doc_id AS question_id, d.source AS db_id,
       coalesce({_extract_sql_sql('c.text')}, '') AS sql,
       {_extract_sql_sql('c.text')} IS NULL AS sql_missing, {_split_reasoning_sql('c.text')} IS NULL AS reasoning_missing
FROM v_completions c JOIN documents d ON d.doc_id = c.doc_id"""))
def q_stream_trace_build(spark, sf):
    from ..session import scratch_path
    from ..streaming.traces import build_traces_stream

    # Stream-static join: each landed response finds its request (question and database).
    requests = _docs(spark, sf).select(F.concat(F.lit("doc"), _s("doc_id")).alias("key"),
                                       F.col("doc_id").alias("question_id"), F.col("source").alias("db_id"))
    t = build_traces_stream(spark, _landing(spark, sf), scratch_path(spark, "r1-sink"), requests=requests)
    return t.select("key", "question_id", "db_id", F.coalesce("sql", F.lit("")).alias("sql"),
                    F.col("sql").isNull().alias("sql_missing"), F.col("reasoning").isNull().alias("reasoning_missing"))


@register("stream_counters", with_views(["v_completions"], f"""
SELECT CASE WHEN {_extract_sql_sql('c.text')} IS NULL THEN 'dropped' ELSE 'kept' END AS outcome, count(*) AS n,
       CAST(sum(CAST(floor(d.n_chars / 4) AS BIGINT)) AS BIGINT) AS prompt_tokens,
       CAST(sum(c.doc_id % 50) AS BIGINT) AS completion_tokens
FROM v_completions c JOIN documents d ON d.doc_id = c.doc_id GROUP BY 1"""))
def q_stream_counters(spark, sf):
    from ..session import scratch_path
    from ..streaming.traces import counters_stream

    return counters_stream(spark, _landing(spark, sf), scratch_path(spark, "r2-sink"))


@register("cost_estimate", _requests_with() + """
, e AS (SELECT sum(floor(length(messages_text) / 4) * (0.15 / 1000000) + 256 * (0.60 / 1000000)) AS est FROM req)
SELECT round(est, 9) AS estimate_usd, round(est * 0.7, 9) AS low_usd, round(est * 1.4, 9) AS high_usd FROM e""")
def q_cost_estimate(spark, sf):
    """P22 pre-run estimate: every request at its full completion ceiling, and the (0.7x, 1.4x)
    range around it."""
    from ..operators.ledger import estimate_range

    req = _requests(spark, sf).withColumn("in_tokens", F.floor(F.length("messages_text") / 4)).withColumn(
        "max_out", F.lit(256))
    r = estimate_range(req, "in_tokens", "max_out")
    return r.select(*[F.round(c, 9).alias(c) for c in ("estimate_usd", "low_usd", "high_usd")])
