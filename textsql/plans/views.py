"""Scaled inputs derived from the driver tables (each defined once for Spark, once for DuckDB).

The driver tables are TPC-H-like plus text corpora; these views give every operator an input of
the pipeline's shape that grows with the scale factor. Views only use arithmetic, CASE, concat
and casts so both engines build identical rows. DuckDB text is used by ``oracle_sql()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import classify_failure
from ..session import spread, spread_rows


# Tables large enough that a scan with fewer splits than cores should be spread (see ``spread``).
_SPREAD = {"orders", "lineitem", "documents", "pages", "conversations", "events", "customer", "part"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in _SPREAD else df


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ----------------------------------------------------------------------------------------------
# outcomes: orders x 3 runs (explode, not a join)
# ----------------------------------------------------------------------------------------------

RUNS = ("base", "student", "teacher")

_GOLD_TEMPLATES = (
    ("SELECT count(*) FROM orders WHERE o_custkey = ", "c"),
    ("SELECT c_name FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = ", "q"),
    ("SELECT o_orderstatus, avg(o_totalprice) FROM orders WHERE o_custkey = ", "c", " GROUP BY o_orderstatus"),
    ("SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey = ", "c", " ORDER BY o_orderpriority"),
)
_WRONG_TEMPLATES = (
    ("SELECT count(*) FROM orders",),
    ("SELECT c_name FROM customer WHERE c_custkey = ", "c"),
    ("SELECT o_orderstatus, sum(o_totalprice) FROM orders WHERE o_custkey = ", "c", " GROUP BY o_orderstatus"),
    ("SELECT o_orderpriority FROM orders\nWHERE o_custkey = ", "c"),
)


def _template_spark(parts, q: Column, c: Column) -> Column:
    pieces = []
    for p in parts:
        pieces.append(q.cast("string") if p == "q" else c.cast("string") if p == "c" else F.lit(p))
    return F.concat(*pieces)


def _template_sql(parts) -> str:
    pieces = []
    for p in parts:
        pieces.append("CAST(o_orderkey AS VARCHAR)" if p == "q" else "CAST(o_custkey AS VARCHAR)" if p == "c"
                      else "'" + p.replace("'", "''") + "'")
    return "concat(" + ", ".join(pieces) + ")"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    runs = F.posexplode(F.array(*[F.lit(r) for r in RUNS]))
    df = o.select("*", runs.alias("k", "run"))
    q, c, k = F.col("o_orderkey"), F.col("o_custkey"), F.col("k")
    empty = (q * (k + 3)) % 11 == 0
    parses = ~empty & ((q + k) % 9 != 0)
    executes = parses & ((q + 2 * k) % 5 != 0)
    good = F.when(k == 0, q % 3 == 0).when(k == 1, q % 3 != 1).otherwise(q % 4 != 3)
    match = executes & good
    exact = match & (q % 8 == k)
    t = q % 4
    gold = F.when(t == 0, _template_spark(_GOLD_TEMPLATES[0], q, c))
    wrong = F.when((q + k) % 4 == 0, _template_spark(_WRONG_TEMPLATES[0], q, c))
    for i in range(1, 4):
        gold = gold.when(t == i, _template_spark(_GOLD_TEMPLATES[i], q, c))
        wrong = wrong.when((q + k) % 4 == i, _template_spark(_WRONG_TEMPLATES[i], q, c))
    pred = (
        F.when(empty, F.lit(""))
        .when(~parses, F.lit("SELECT (p_name FROM part"))
        .when(~executes, F.lit("SELECT * FROM missing_part_list"))
        .when(exact, gold)
        .when(match, F.replace(gold, F.lit(" = "), F.lit("=")))
        .otherwise(wrong)
    )
    diff = F.substring("o_orderpriority", 1, 1)
    difficulty = (F.when(diff == "1", "easy").when(diff == "2", "medium").when(diff == "3", "hard")
                  .when(diff == "4", "extra").otherwise("unknown"))
    out = df.select(
        "run",
        q.alias("question_id"),
        F.concat(F.lit("db"), (c % 20).cast("string")).alias("db_id"),
        difficulty.alias("difficulty"),
        gold.alias("gold_sql"),
        pred.alias("pred_sql"),
        parses.alias("parses"),
        executes.alias("executes"),
        match.alias("exec_match"),
        exact.alias("exact_set_match"),
    )
    return out.withColumn("failure_mode", classify_failure("pred_sql", "parses", "executes", "exec_match"))


def _outcomes_sql() -> str:
    gold = "CASE " + " ".join(
        f"WHEN o_orderkey % 4 = {i} THEN {_template_sql(_GOLD_TEMPLATES[i])}" for i in range(4)) + " END"
    wrong = "CASE " + " ".join(
        f"WHEN (o_orderkey + k) % 4 = {i} THEN {_template_sql(_WRONG_TEMPLATES[i])}" for i in range(4)) + " END"
    return f"""
v_outcomes_base AS (
  SELECT r.run, r.k, o.o_orderkey, o.o_custkey, o.o_orderpriority,
         (o.o_orderkey * (r.k + 3)) % 11 = 0 AS is_empty
  FROM orders o CROSS JOIN (VALUES ('base', 0), ('student', 1), ('teacher', 2)) r(run, k)
),
v_outcomes_flags AS (
  SELECT *, NOT is_empty AND (o_orderkey + k) % 9 <> 0 AS parses FROM v_outcomes_base
),
v_outcomes_flags2 AS (
  SELECT *, parses AND (o_orderkey + 2 * k) % 5 <> 0 AS executes FROM v_outcomes_flags
),
v_outcomes_flags3 AS (
  SELECT *, executes AND (CASE WHEN k = 0 THEN o_orderkey % 3 = 0 WHEN k = 1 THEN o_orderkey % 3 <> 1
                               ELSE o_orderkey % 4 <> 3 END) AS exec_match,
         {gold} AS gold_sql, {wrong} AS wrong_sql
  FROM v_outcomes_flags2
),
v_outcomes_pre AS (
  SELECT run, o_orderkey AS question_id, concat('db', CAST(o_custkey % 20 AS VARCHAR)) AS db_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'easy' WHEN '2' THEN 'medium'
              WHEN '3' THEN 'hard' WHEN '4' THEN 'extra' ELSE 'unknown' END AS difficulty,
         gold_sql,
         CASE WHEN is_empty THEN '' WHEN NOT parses THEN 'SELECT (p_name FROM part'
              WHEN NOT executes THEN 'SELECT * FROM missing_part_list'
              WHEN exec_match AND o_orderkey % 8 = k THEN gold_sql
              WHEN exec_match THEN replace(gold_sql, ' = ', '=')
              ELSE wrong_sql END AS pred_sql,
         parses, executes, exec_match, exec_match AND o_orderkey % 8 = k AS exact_set_match
  FROM v_outcomes_flags3
),
v_outcomes AS (
  SELECT *, {failure_mode_sql('pred_sql', 'parses', 'executes', 'exec_match')} AS failure_mode
  FROM v_outcomes_pre
)"""


# ----------------------------------------------------------------------------------------------
# Shared SQL snippets mirroring the Column builders
# ----------------------------------------------------------------------------------------------

def py_ws_sql() -> str:
    from ..functions.text import PY_WHITESPACE

    return "'" + PY_WHITESPACE + "'"


def strip_sql(x: str) -> str:
    return f"trim({x}, {py_ws_sql()})"


def clean_sql_sql(x: str) -> str:
    return strip_sql(f"rtrim({strip_sql(x)}, ';')")


def failure_mode_sql(pred: str, parses: str, executes: str, match: str) -> str:
    return (f"CASE WHEN coalesce({match}, false) THEN 'ok' "
            f"WHEN coalesce({strip_sql(pred)}, '') = '' THEN 'empty' "
            f"WHEN NOT coalesce({parses}, false) THEN 'parse' "
            f"WHEN NOT coalesce({executes}, false) THEN 'execution' ELSE 'wrong-result' END")


# ----------------------------------------------------------------------------------------------
# gold_rows / pred_rows: lineitem rows as result rows of question l_orderkey
# ----------------------------------------------------------------------------------------------

def _row_cells(flag_lower: Column | None = None, null_as_empty: Column | None = None) -> Column:
    qty = F.floor("l_quantity").cast("bigint").cast("string")
    qty_cell = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string")).otherwise(qty)
    if null_as_empty is not None:
        qty_cell = F.when(null_as_empty & qty_cell.isNull(), F.lit("")).otherwise(qty_cell)
    flag = F.col("l_returnflag")
    if flag_lower is not None:
        flag = F.when(flag_lower, F.lower(flag)).otherwise(flag)
    return F.array(_s("l_partkey"), _s("l_suppkey"), _s("l_linenumber"), flag, F.col("l_linestatus"), qty_cell)


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("question_id"), _row_cells().alias("row"))


def pred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By l_orderkey % 5: 0 same rows, 1 first line dropped, 2 first line twice, 3 NULL cell
    given as '', 4 second line's flag lower-cased. One scan: each line yields 0, 1 or 2 copies."""
    li = read(spark, sf_dir, "lineitem")
    m = F.col("l_orderkey") % 5
    ln = F.col("l_linenumber")
    copies = F.when((m == 1) & (ln == 1), 0).when((m == 2) & (ln == 1), 2).otherwise(1)
    row = _row_cells(flag_lower=(m == 4) & (ln == 2), null_as_empty=(m == 3))
    return li.select(F.col("l_orderkey").alias("question_id"), F.explode(F.array_repeat(row, copies)).alias("row"))


_ROW_SQL = ("[CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), {flag}, "
            "l_linestatus, {qty}]")
_QTY_SQL = "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) END"

ROWS_SQL = f"""
v_gold_rows AS (
  SELECT l_orderkey AS question_id, {_ROW_SQL.format(flag='l_returnflag', qty=_QTY_SQL)} AS row FROM lineitem
),
v_pred_rows AS (
  SELECT l_orderkey AS question_id,
         {_ROW_SQL.format(
             flag="CASE WHEN l_orderkey % 5 = 4 AND l_linenumber = 2 THEN lower(l_returnflag) ELSE l_returnflag END",
             qty=f"CASE WHEN l_orderkey % 5 = 3 AND ({_QTY_SQL}) IS NULL THEN '' ELSE {_QTY_SQL} END")} AS row
  FROM lineitem WHERE NOT (l_orderkey % 5 = 1 AND l_linenumber = 1)
  UNION ALL
  SELECT l_orderkey, {_ROW_SQL.format(flag='l_returnflag', qty=_QTY_SQL)} FROM lineitem
  WHERE l_orderkey % 5 = 2 AND l_linenumber = 1
)"""


# ----------------------------------------------------------------------------------------------
# sql_pairs: one templated (gold, prediction) pair per order, 12 shapes
# ----------------------------------------------------------------------------------------------

# (gold parts, pred parts, failure). "c" = o_custkey, "q" = o_orderkey, "p" = floor(o_totalprice).
PAIR_TEMPLATES = (
    (("SELECT count(*) FROM orders WHERE o_custkey = ", "c"), ("",), "empty"),
    (("SELECT o_orderkey FROM orders WHERE o_custkey = ", "c", ";"), ("SELECT (p_name FROM part",), "parse"),
    (("SELECT c_name FROM customer WHERE c_custkey = ", "c"), ("SELECT c_name FROM missing_part_list WHERE id = ", "c"), "execution"),
    (("SELECT c.c_name FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = ", "q"),
     ("SELECT c_name FROM customer WHERE c_custkey = ", "c"), "wrong-result"),
    (("SELECT o_totalprice FROM orders WHERE o_orderkey = ", "q"),
     ("SELECT o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = ", "q"), "wrong-result"),
    (("SELECT avg(o_totalprice) FROM orders WHERE o_custkey = ", "c"),
     ("SELECT SUM (o_totalprice) FROM orders WHERE o_custkey = ", "c"), "wrong-result"),
    (("SELECT o_orderstatus, count(*) FROM orders WHERE o_custkey = ", "c", " GROUP BY o_orderstatus"),
     ("SELECT o_orderstatus, count(*) FROM orders WHERE o_custkey = ", "c"), "wrong-result"),
    (("SELECT o_orderkey FROM orders\nWHERE o_totalprice > ", "p", " AND o_orderstatus = 'F'"),
     ("SELECT o_orderkey FROM orders",), "wrong-result"),
    (("SELECT count(*) FROM orders",),
     ("select count(*) from orders, customer where o_custkey = c_custkey and o_totalprice > ", "p"), "wrong-result"),
    (("SELECT o_orderkey FROM orders WHERE o_custkey = ", "c", " ORDER BY o_totalprice DESC LIMIT 3"),
     ("SELECT o_orderkey FROM orders WHERE o_custkey = ", "c", " LIMIT 3"), "wrong-result"),
    (("SELECT DISTINCT o_orderstatus FROM orders WHERE o_custkey = ", "c"),
     ("SELECT o_orderstatus FROM orders WHERE o_custkey = ", "c"), "wrong-result"),
    (("WITH big AS (SELECT * FROM orders WHERE o_totalprice > ", "p", ") SELECT count(*) FROM big "
      "UNION SELECT count(*) FROM lineitem",),
     ("  with BIG as (select * from ORDERS where O_TOTALPRICE > ", "p", ") select COUNT(*) from big\n"
      "union select count(*) from lineitem ;  ",), "ok"),
    (("SELECT count(*) FROM orders CROSS JOIN (region) WHERE o_custkey = ", "c"),
     ("SELECT count(*) FROM (orders JOIN customer ON o_custkey = c_custkey) WHERE o_custkey = ", "c"), "wrong-result"),
    (("SELECT \"from x\" FROM nation JOIN region, part WHERE n_nationkey = ", "q"),
     ("SELECT n_name FROM nation -- from part\n, supplier WHERE n_nationkey = ", "q"), "wrong-result"),
    (("SELECT EXTRACT(year FROM o_orderdate) FROM orders WHERE o_custkey IS DISTINCT FROM ", "c"),
     ("SELECT trim(BOTH 'x' FROM o_comment) FROM main.orders o /* from lineitem */ WHERE o_orderkey = ", "q"), "wrong-result"),
    (("SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem, part GROUP BY l_partkey) AS t, supplier WHERE n > ", "p"),
     ("SELECT * FROM range(", "p", ") AS r, (VALUES (1, 2)) AS v, [nation] ORDER BY 1"), "wrong-result"),
    (("WITH RECURSIVE up(n) AS (SELECT ", "q", " UNION ALL SELECT n + 1 FROM up JOIN customer ON n < c_custkey), b AS "
      "(SELECT * FROM up) SELECT * FROM b WHERE EXISTS (SELECT 1 FROM `Supplier` WHERE s_suppkey = n)",),
     ("SELECT n FROM up",), "execution"),
)
# Expected for each template, written out by hand: the tables that gold and prediction name (a text that is no
# statement, with its FROM inside an open parenthesis, names none).
PAIR_TABLES = (
    ("orders", ""), ("orders", ""), ("customer", "missing_part_list"), ("customer,orders", "customer"),
    ("orders", "customer,orders"), ("orders", "orders"), ("orders", "orders"), ("orders", "orders"), ("orders", "customer,orders"),
    ("orders", "orders"), ("orders", "orders"), ("lineitem,orders", "lineitem,orders"),
    ("orders,region", "customer,orders"), ("nation,part,region", "nation,supplier"), ("orders", "orders"),
    ("lineitem,part,supplier", "nation"), ("customer,supplier", "up"),
)
# Expected fingerprints, written out by hand, with the same places as in the templates.
PAIR_FINGERPRINTS = (
    (("select count ( * ) from orders where o_custkey = ", "c"), ("",)),
    (("select o_orderkey from orders where o_custkey = ", "c"), ("select ( p_name from part",)),
    (("select c_name from customer where c_custkey = ", "c"), ("select c_name from missing_part_list where id = ", "c")),
    (("select c . c_name from customer as c join orders as o on c . c_custkey = o . o_custkey where o . o_orderkey = ", "q"),
     ("select c_name from customer where c_custkey = ", "c")),
    (("select o_totalprice from orders where o_orderkey = ", "q"),
     ("select o . o_totalprice from orders o join customer c on o . o_custkey = c . c_custkey where o . o_orderkey = ", "q")),
    (("select avg ( o_totalprice ) from orders where o_custkey = ", "c"), ("select sum ( o_totalprice ) from orders where o_custkey = ", "c")),
    (("select o_orderstatus , count ( * ) from orders where o_custkey = ", "c", " group by o_orderstatus"),
     ("select o_orderstatus , count ( * ) from orders where o_custkey = ", "c")),
    (("select o_orderkey from orders where o_totalprice > ", "p", " and o_orderstatus = 'F'"), ("select o_orderkey from orders",)),
    (("select count ( * ) from orders",),
     ("select count ( * ) from orders , customer where o_custkey = c_custkey and o_totalprice > ", "p")),
    (("select o_orderkey from orders where o_custkey = ", "c", " order by o_totalprice desc limit 3"),
     ("select o_orderkey from orders where o_custkey = ", "c", " limit 3")),
    (("select distinct o_orderstatus from orders where o_custkey = ", "c"), ("select o_orderstatus from orders where o_custkey = ", "c")),
    (("with big as ( select * from orders where o_totalprice > ", "p", " ) select count ( * ) from big union select count ( * ) from lineitem"),
     ("with big as ( select * from orders where o_totalprice > ", "p", " ) select count ( * ) from big union select count ( * ) from lineitem")),
    (("select count ( * ) from orders cross join ( region ) where o_custkey = ", "c"),
     ("select count ( * ) from ( orders join customer on o_custkey = c_custkey ) where o_custkey = ", "c")),
    (("select \"from x\" from nation join region , part where n_nationkey = ", "q"),
     ("select n_name from nation , supplier where n_nationkey = ", "q")),
    (("select extract ( year from o_orderdate ) from orders where o_custkey is distinct from ", "c"),
     ("select trim ( both 'x' from o_comment ) from main . orders o where o_orderkey = ", "q")),
    (("select max ( n ) from ( select count ( * ) as n from lineitem , part group by l_partkey ) as t , supplier where n > ", "p"),
     ("select * from range ( ", "p", " ) as r , ( values ( 1 , 2 ) ) as v , [nation] order by 1")),
    (("with recursive up ( n ) as ( select ", "q", " union all select n + 1 from up join customer on n < c_custkey ) , b as "
      "( select * from up ) select * from b where exists ( select 1 from `Supplier` where s_suppkey = n )"),
     ("select n from up",)),
)


def by_template_sql(texts) -> str:
    """CASE over a pair's template: its expected text, as template parts or as one literal."""
    n = len(PAIR_TEMPLATES)
    assert len(texts) == n
    parts = [[x] if isinstance(x, str) else x for x in texts]
    return f"CASE question_id % {n} " + " ".join(
        f"WHEN {i} THEN concat({', '.join(_pair_part_sql(x) for x in p)})" for i, p in enumerate(parts)) + " END"


def _pair_part_spark(p: str) -> Column:
    if p == "c":
        return F.col("o_custkey").cast("string")
    if p == "q":
        return F.col("o_orderkey").cast("string")
    if p == "p":
        return F.floor("o_totalprice").cast("bigint").cast("string")
    return F.lit(p)


def _pair_part_sql(p: str) -> str:
    if p == "c":
        return "CAST(o_custkey AS VARCHAR)"
    if p == "q":
        return "CAST(o_orderkey AS VARCHAR)"
    if p == "p":
        return "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"
    return "'" + p.replace("'", "''") + "'"


def sql_pairs(spark: SparkSession, sf_dir: str, rows_per_task: int | None = None) -> DataFrame:
    """``rows_per_task`` bounds a task's rows for queries that work long on each pair."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    if rows_per_task:
        o = spread_rows(o, rows_per_task)
    t = F.col("o_orderkey") % len(PAIR_TEMPLATES)
    gold = pred = fail = None
    for i, (g, p, f) in enumerate(PAIR_TEMPLATES):
        gc = F.concat(*[_pair_part_spark(x) for x in g])
        pc = F.concat(*[_pair_part_spark(x) for x in p])
        gold = F.when(t == i, gc) if gold is None else gold.when(t == i, gc)
        pred = F.when(t == i, pc) if pred is None else pred.when(t == i, pc)
        fail = F.when(t == i, F.lit(f)) if fail is None else fail.when(t == i, F.lit(f))
    return o.select(F.col("o_orderkey").alias("question_id"), gold.alias("gold_sql"), pred.alias("pred_sql"),
                    fail.alias("failure"))


def _sql_pairs_sql() -> str:
    n = len(PAIR_TEMPLATES)
    gold = "CASE " + " ".join(
        f"WHEN o_orderkey % {n} = {i} THEN concat({', '.join(_pair_part_sql(x) for x in g)})"
        for i, (g, _, _) in enumerate(PAIR_TEMPLATES)) + " END"
    pred = "CASE " + " ".join(
        f"WHEN o_orderkey % {n} = {i} THEN concat({', '.join(_pair_part_sql(x) for x in p)})"
        for i, (_, p, _) in enumerate(PAIR_TEMPLATES)) + " END"
    fail = "CASE " + " ".join(
        f"WHEN o_orderkey % {n} = {i} THEN '{f}'" for i, (_, _, f) in enumerate(PAIR_TEMPLATES)) + " END"
    return f"""
v_sql_pairs AS (
  SELECT o_orderkey AS question_id, {gold} AS gold_sql, {pred} AS pred_sql, {fail} AS failure FROM orders
)"""


# ----------------------------------------------------------------------------------------------
# completions: documents wrapped as model answers (6 shapes)
# ----------------------------------------------------------------------------------------------

def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 6
    sel = F.concat(F.lit("SELECT n_chars FROM documents WHERE doc_id = "), F.col("doc_id").cast("string"), F.lit(";"))
    t = F.col("text")
    wrapped = (
        F.when(k == 0, F.concat(t, F.lit("\n\n```sql\n"), sel, F.lit("\n```")))
        .when(k == 1, F.concat(t, F.lit("\n```SQLite  \n"), sel, F.lit("\n```\n")))
        .when(k == 2, F.concat(F.lit("```\n"), sel, F.lit("\n```\n"), t))
        .when(k == 3, F.concat(t, F.lit("\n```sql\nSELECT 1;\n```\nthen\n```sql\n"), sel, F.lit(";;\n```")))
        .when(k == 4, F.concat(F.lit("  select * from documents -- "), t, F.lit(" ;")))
        .when(F.col("doc_id") % 12 == 11, F.concat(t, F.lit("\n```sql\nSELECT unclosed")))
        .otherwise(t)
    )
    return d.select("doc_id", wrapped.alias("text"))


COMPLETIONS_SQL = """
v_completions AS (
  SELECT doc_id,
    CASE doc_id % 6
      WHEN 0 THEN concat(text, chr(10) || chr(10) || '```sql' || chr(10), 'SELECT n_chars FROM documents WHERE doc_id = ' || CAST(doc_id AS VARCHAR) || ';', chr(10) || '```')
      WHEN 1 THEN concat(text, chr(10) || '```SQLite  ' || chr(10), 'SELECT n_chars FROM documents WHERE doc_id = ' || CAST(doc_id AS VARCHAR) || ';', chr(10) || '```' || chr(10))
      WHEN 2 THEN concat('```' || chr(10), 'SELECT n_chars FROM documents WHERE doc_id = ' || CAST(doc_id AS VARCHAR) || ';', chr(10) || '```' || chr(10), text)
      WHEN 3 THEN concat(text, chr(10) || '```sql' || chr(10) || 'SELECT 1;' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```sql' || chr(10), 'SELECT n_chars FROM documents WHERE doc_id = ' || CAST(doc_id AS VARCHAR) || ';', ';;' || chr(10) || '```')
      WHEN 4 THEN concat('  select * from documents -- ', text, ' ;')
      ELSE CASE WHEN doc_id % 12 = 11 THEN concat(text, chr(10) || '```sql' || chr(10) || 'SELECT unclosed') ELSE text END
    END AS text
  FROM documents
)"""


# ----------------------------------------------------------------------------------------------
# candidates: lineitem rows as sampled candidates of question l_orderkey
# ----------------------------------------------------------------------------------------------

def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id = l_orderkey; sample order = (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate).

    ``sample_index`` is ``l_linenumber - 1`` and the remaining order columns form the total
    tie-break (``sample_key``), so "first by sample index" needs no window.
    """
    li = read(spark, sf_dir, "lineitem")
    parses = F.col("l_returnflag") != "R"
    executes = parses & (F.col("l_linestatus") == "F")
    matches = executes & (F.col("l_quantity") > 25)
    m = F.col("l_partkey") % 10
    sql = (
        F.when(m == 0, F.lit(None).cast("string"))
        .when(m == 1, F.lit("   "))
        .when(m == 2, F.concat(F.lit("SELECT * FROM ghost_table WHERE id = "), _s("l_partkey")))
        .otherwise(F.concat(F.lit("SELECT l_quantity FROM lineitem WHERE l_partkey = "), _s("l_partkey")))
    )
    return li.select(
        F.col("l_orderkey").alias("question_id"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("sample_index"),
        F.struct(
            F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"),
            F.col("l_extendedprice").alias("d"), F.col("l_shipdate").alias("e"),
        ).alias("sample_key"),
        sql.alias("sql"),
        parses.alias("parses_ok"),
        executes.alias("executes_ok"),
        matches.alias("matches_gold"),
    )


def cand_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the candidate fixture: every order (orders without lines have no candidates)."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(F.lit("db"), (F.col("o_orderkey") % 20).cast("string")).alias("db_id"),
        (F.col("o_orderkey") % 13 != 0).alias("gold_ok"),
        (F.col("o_orderkey") % 17 != 0).alias("has_schema"),
    )


CANDIDATES_SQL = """
v_candidates AS (
  SELECT l_orderkey AS question_id, CAST(l_linenumber - 1 AS BIGINT) AS sample_index,
         l_linenumber AS k_a, l_partkey AS k_b, l_suppkey AS k_c, l_extendedprice AS k_d, l_shipdate AS k_e,
         CASE l_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '   '
              WHEN 2 THEN 'SELECT * FROM ghost_table WHERE id = ' || CAST(l_partkey AS VARCHAR)
              ELSE 'SELECT l_quantity FROM lineitem WHERE l_partkey = ' || CAST(l_partkey AS VARCHAR) END AS sql,
         l_returnflag <> 'R' AS parses_ok,
         l_returnflag <> 'R' AND l_linestatus = 'F' AS executes_ok,
         l_returnflag <> 'R' AND l_linestatus = 'F' AND l_quantity > 25 AS matches_gold
  FROM lineitem
),
v_cand_questions AS (
  SELECT o_orderkey AS question_id, 'db' || CAST(o_orderkey % 20 AS VARCHAR) AS db_id,
         o_orderkey % 13 <> 0 AS gold_ok, o_orderkey % 17 <> 0 AS has_schema
  FROM orders
)"""


# ----------------------------------------------------------------------------------------------
# questions, BM25 corpus, FK edges
# ----------------------------------------------------------------------------------------------

# The databases that ``questions`` names: blocks of 400 ids of one source, of 20 ids for the first five sources.
# The linking queries rank all documents of a source (``source_questions``, ``corpus``).
def _block_width(n: str) -> str:
    return f"CASE WHEN {n} < 5 THEN 20 ELSE 400 END"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each asked of one database: source by item, block by item."""
    last = read(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0  # one number
    b = read(spark, sf_dir, "benchmark")
    n = F.col("item_id") % 20
    blocks = F.floor(F.lit(last) / F.expr(_block_width("item_id % 20"))) + 1
    return b.select(
        F.col("item_id").alias("question_id"),
        F.concat(F.lit("src"), n.cast("string"), F.lit("_"), (F.col("item_id") % blocks).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
        F.concat(F.lit("SELECT count(*) FROM documents WHERE doc_id = "), _s("item_id")).alias("query"),
    )


QUESTIONS_SQL = f"""
v_questions AS (
  SELECT item_id AS question_id,
         'src' || CAST(item_id % 20 AS VARCHAR) || '_' ||
         CAST(item_id % ((SELECT max(doc_id) FROM documents) // {_block_width('item_id % 20')} + 1) AS VARCHAR) AS db_id,
         text AS question, 'SELECT count(*) FROM documents WHERE doc_id = ' || CAST(item_id AS VARCHAR) AS query
  FROM benchmark
)"""


def source_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, each asked of all documents of one source."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("question_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("db_id"),
        F.col("text").alias("question"),
        F.concat(F.lit("SELECT count(*) FROM documents WHERE doc_id = "), _s("item_id")).alias("query"),
    )


SOURCE_QUESTIONS_SQL = """
v_questions AS (
  SELECT item_id AS question_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS db_id, text AS question,
         'SELECT count(*) FROM documents WHERE doc_id = ' || CAST(item_id AS VARCHAR) AS query
  FROM benchmark
)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 documents: database = source, table = document (index = doc_id), text = document text."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("db_id"), F.col("doc_id").alias("table_index"), "text")


CORPUS_SQL = """
v_corpus AS (SELECT source AS db_id, doc_id AS table_index, text FROM documents)"""


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge ``doc -> doc // 2`` when both are in the same source; FK list order = from doc_id."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    parent = d.select(F.col("doc_id").alias("to_table"), F.col("source").alias("db_id"))
    child = d.select(F.col("doc_id").alias("from_table"), F.col("source").alias("db_id"),
                     F.floor(F.col("doc_id") / 2).cast("bigint").alias("to_table"))
    e = child.join(parent, on=["db_id", "to_table"], how="inner")
    return e.select("db_id", F.col("from_table").alias("pos"), "from_table", "to_table")


FK_EDGES_SQL = """
v_fk_edges AS (
  SELECT c.source AS db_id, c.doc_id AS pos, c.doc_id AS from_table, p.doc_id AS to_table
  FROM documents c JOIN documents p ON p.source = c.source AND p.doc_id = c.doc_id // 2
)"""


# ----------------------------------------------------------------------------------------------
# calls: events as model calls (ledger)
# ----------------------------------------------------------------------------------------------

def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id", "ts", F.col("event_type").alias("model"),
        (F.coalesce(k, F.lit(0)) * 10 + 100).alias("in_tokens"),
        F.coalesce(k, F.lit(0)).alias("out_tokens"),
        F.col("value").alias("seconds"),
        F.col("user_id").alias("ledger"),
    )


CALLS_SQL = """
v_calls AS (
  SELECT event_id, ts, event_type AS model,
         coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) * 10 + 100 AS in_tokens,
         coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS out_tokens,
         value AS seconds, user_id AS ledger
  FROM events
)"""


VIEW_SQL = {
    "v_outcomes": _outcomes_sql(),
    "v_rows": ROWS_SQL,
    "v_sql_pairs": _sql_pairs_sql(),
    "v_completions": COMPLETIONS_SQL,
    "v_candidates": CANDIDATES_SQL,
    "v_questions": QUESTIONS_SQL,
    "v_source_questions": SOURCE_QUESTIONS_SQL,  # also named v_questions in its query
    "v_corpus": CORPUS_SQL,
    "v_fk_edges": FK_EDGES_SQL,
    "v_calls": CALLS_SQL,
}


def with_views(names, body: str) -> str:
    """DuckDB query text: the named view CTEs followed by ``body``."""
    ctes = ",\n".join(VIEW_SQL[n].strip() for n in names)
    return f"WITH {ctes}\n{body}"


# ----------------------------------------------------------------------------------------------
# raw catalog (tables.json layout): one database per order, one table per line item
# ----------------------------------------------------------------------------------------------

def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database ``ord<k>``; tables = the order's lines in (linenumber, partkey, suppkey,
    extendedprice, shipdate) order; 3 columns each; first column is the key; FK from the second
    column of every later table to the first column of table 0; one FK pair touches the
    sentinel and must be dropped by the reader. An order has a handful of lines, so a database
    row is small by construction."""
    li = read(spark, sf_dir, "lineitem")
    # only what the names are made of is shuffled; ``ty`` is the type's rank in text order, so ties sort as by its text
    ty = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0).otherwise(2)
    t = li.select("l_orderkey", F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"),
                                         F.col("l_extendedprice").alias("d"), F.col("l_shipdate").alias("e"),
                                         ty.cast("byte").alias("ty")).alias("t"))
    g = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("t")).alias("lines"))

    def names(x):
        ln, part, supp = x["a"], x["b"].cast("string"), x["c"].cast("string")
        return F.struct(
            F.when(ln % 3 == 0, F.concat(F.lit("line "), ln.cast("string")))
            .when(ln % 3 == 1, F.concat(F.lit("line_"), ln.cast("string"), F.lit("_"), part))
            .otherwise(F.concat(F.lit('l"'), supp)).alias("tname"),
            F.concat(F.lit("part_"), part).alias("c0"),
            F.when(ln == 3, F.concat(F.lit("3rd supp "), supp)).otherwise(F.concat(F.lit("supp_"), supp)).alias("c1"),
            F.when(x["ty"] == 1, "text").when(x["ty"] == 0, "").otherwise("varchar(1)").alias("ty2"))

    g = g.select("l_orderkey", F.transform("lines", names).alias("tabs"))
    n = F.size("tabs")
    cols = F.flatten(F.transform("tabs", lambda x, i: F.array(
        F.array(i.cast("string"), x["c0"]), F.array(i.cast("string"), x["c1"]), F.array(i.cast("string"), F.lit("flag")))))
    types = F.flatten(F.transform("tabs", lambda x: F.array(F.lit("number"), F.lit("number"), x["ty2"])))
    pks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * 3 + 1).cast("bigint"))
    fks = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                    lambda i: F.array((i * 3 + 2).cast("bigint"), F.lit(1).cast("bigint")))) \
        .otherwise(F.array().cast("array<array<bigint>>"))
    return g.select(
        F.concat(F.lit("ord"), _s("l_orderkey")).alias("db_id"),
        F.transform("tabs", lambda x: x["tname"]).alias("table_names_original"),
        F.concat(F.array(F.array(F.lit("-1"), F.lit("*"))), cols).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), types).alias("column_types"),
        pks.alias("primary_keys"),
        F.concat(F.array(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))), fks).alias("foreign_keys"),
    )


RAW_CATALOG_SQL = """
v_cat_tabs AS (
  SELECT l_orderkey,
         list(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice, e := l_shipdate,
              tname := CASE WHEN l_linenumber % 3 = 0 THEN 'line ' || CAST(l_linenumber AS VARCHAR)
                            WHEN l_linenumber % 3 = 1 THEN 'line_' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR)
                            ELSE 'l"' || CAST(l_suppkey AS VARCHAR) END,
              c0 := 'part_' || CAST(l_partkey AS VARCHAR),
              c1 := CASE WHEN l_linenumber = 3 THEN '3rd supp ' || CAST(l_suppkey AS VARCHAR) ELSE 'supp_' || CAST(l_suppkey AS VARCHAR) END,
              ty2 := CASE WHEN l_returnflag = 'A' THEN 'text' WHEN l_returnflag = 'N' THEN '' ELSE 'varchar(1)' END)
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS tabs
  FROM lineitem GROUP BY l_orderkey
),
v_cat_flat AS (
  SELECT 'ord' || CAST(l_orderkey AS VARCHAR) AS db_id, tabs, generate_subscripts(tabs, 1) - 1 AS table_index,
         unnest(tabs) AS tab
  FROM v_cat_tabs
)"""
VIEW_SQL["v_raw_catalog"] = RAW_CATALOG_SQL
