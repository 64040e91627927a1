"""Statement execution (X1, F2, F3) and end-to-end scoring of SQL pairs.

SQL here is *data*: a list of statements as large as any table. The distinct statements are written
once, numbered in batches, as a work table in the shared folder. The driver takes a bounded window of
batches at a time, analyses each statement (no job runs) and lets the executors write a batch's rows;
the batch's status file, written last and in one piece, is its commit. A run that is called again
with the same work folder goes on after the committed batches, so neither the number of statements
nor a lost driver matters. Rows of attempts that were cut off are never read: a status names the
directory that holds its rows.

Statements run in child sessions that can only read: a text counts as a query only where Spark's
parser takes it in parentheses or as the body of a view, paths don't resolve as tables, and the functions that call into the
JVM resolve to nothing. Status: ``ok``; ``parse`` (no statement at all); ``execution`` (analysis or runtime error,
refused non-query or function, timeout); ``empty`` for a blank statement.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from logging import LogRecord

from pyspark.errors import AnalysisException, ParseException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import clean_sql
from ..session import maybe_broadcast, scratch_path
from .ranking import exact_rank
from .resultset import multiset_classes, multiset_equal

# --- fixed values -----------------------------------------------------------------------------
# functions that run arbitrary JVM methods, and a class that handles no call: what is named by it fails when it is analysed
REFUSED_FUNCTIONS = ("java_method", "reflect", "try_reflect")
NO_FUNCTION = "java.lang.Void"
# errors of names that aren't there or are refused: the same in parentheses, in a view's body and in the statement itself
UNRESOLVED = ("UNRESOLVED_COLUMN", "TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_ROUTINE", "NO_HANDLER_FOR_UDAF")
# ----------------------------------------------------------------------------------------------
BATCH_SIZE = 32  # statements of a batch: one job a database
WINDOW = 64  # batches whose texts the driver holds at once
SESSIONS = 64  # child sessions kept open
ANALYSTS = 4  # threads that analyse statements, for each batch that runs; they mostly wait for the JVM

STATUS_SCHEMA = StructType([
    StructField("stmt_id", StringType(), False),
    StructField("status", StringType(), False),
    StructField("error", StringType(), True),
    StructField("tag", StringType(), True),
])
ROWS_SCHEMA = StructType([
    StructField("row", ArrayType(StringType()), True),
    StructField("stmt_id", StringType(), True),
    StructField("tag", StringType(), True),
])
TODO_SCHEMA = StructType([
    StructField("stmt_id", StringType(), False),
    StructField("db", StringType(), True),
    StructField("text", StringType(), False),
    StructField("batch", LongType(), False),
    StructField("window", LongType(), False),
])
PLAN_SCHEMA = StructType([StructField("todo", StringType(), False), StructField("batches", LongType(), False)])


_ANALYST = "textsql-analyst"


def statement_id(sql_col, db_col=None) -> F.Column:
    """sha256 of the cleaned text, or of ``db_id <US> text`` when statements are per database."""
    text = F.coalesce(clean_sql(sql_col), F.lit(""))
    if db_col is not None:
        text = F.concat_ws("\x1f", F.coalesce(F.col(db_col) if isinstance(db_col, str) else db_col, F.lit("")), text)
    return F.sha2(text, 256)


def read_only_session(spark: SparkSession) -> SparkSession:
    """A child session (same cluster, own views) with the caller's SQL settings, in which a path is no table
    and the functions that call JVM methods fail."""
    child = spark.newSession()
    for r in spark.sql("SET").collect():
        if r["key"].startswith("spark.sql.") and child.conf.isModifiable(r["key"]):
            child.conf.set(r["key"], r["value"])
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    for name in REFUSED_FUNCTIONS:
        child.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} AS '{NO_FUNCTION}'")
    return child


def _shared_views(spark: SparkSession, child: SparkSession) -> list[str]:
    """Give the caller's temporary views to a child session; returns the global views that carry them."""
    shared = []
    child.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    for t in spark.catalog.listTables():
        if t.isTemporary:
            via = f"textsql_{uuid.uuid4().hex[:12]}"
            spark.table(f"`{t.name}`").createGlobalTempView(via)
            child.table(f"global_temp.{via}").createOrReplaceTempView(t.name)
            shared.append(via)
    return shared


class _Sessions:
    """The read-only session of each database; at most ``SESSIONS`` are kept."""

    def __init__(self, spark: SparkSession, tables_for: Callable | None):
        self.spark, self.tables_for, self.open, self.lock, self.shared = spark, tables_for, OrderedDict(), threading.Lock(), []

    def get(self, db: str | None) -> SparkSession:
        with self.lock:
            if db not in self.open:
                child = read_only_session(self.spark)
                if db is None:
                    self.shared += _shared_views(self.spark, child)
                elif self.tables_for is not None:
                    for name, df in self.tables_for(child, db).items():
                        df.createOrReplaceTempView(name)
                else:
                    child.catalog.setCurrentDatabase(db)
                self.open[db] = child
                while len(self.open) > SESSIONS:
                    self.open.popitem(last=False)
            self.open.move_to_end(db)
            return self.open[db]

    def close(self) -> None:
        for view in self.shared:
            self.spark.catalog.dropGlobalTempView(view)


def _not_of_analysts(record: LogRecord) -> bool:
    """An error in a statement is its status; PySpark need not write a stack trace of it to its log."""
    return not (record.threadName or "").startswith(_ANALYST)


def _parses(sess: SparkSession, text: str) -> bool:
    """Spark's own parser decides; EXPLAIN runs nothing."""
    try:
        sess.sql(f"EXPLAIN {text}")
        return True
    except ParseException:
        return False
    except AnalysisException:
        return True


def _is_query(sess: SparkSession, text: str) -> tuple[bool, str | None]:
    """Only a query can stand in parentheses (where nothing is executed) or be the body of a view: no command, and no write
    below a WITH. With it the error of a query that names what isn't there, which would fail again in the same way.
    What starts with a parenthesis is always a query, and a text that parses by itself can't close it."""
    probe = f"textsql_probe_{uuid.uuid4().hex[:12]}"
    try:
        try:
            sess.sql(f"(\n{text}\n)")
        except ParseException:  # a view's body may end in semicolons
            sess.sql(f"CREATE TEMPORARY VIEW {probe} AS\n{text}")
            sess.catalog.dropTempView(probe)
        return True, None
    except ParseException:
        return False, None
    except AnalysisException as e:  # a query that doesn't resolve, or one that can't be a view
        condition = getattr(e, "getCondition", lambda: None)() or ""
        return True, condition if condition.startswith(UNRESOLVED) else None


def _analyze(sess: SparkSession, sid: str, text: str):
    """(status, error, rows) of one statement; no job runs."""
    if not text:
        return "empty", None, None
    try:
        query, unresolved = _is_query(sess, text)
        if unresolved:
            return "execution", unresolved, None
        if not query:
            return ("execution", "refused: not a read-only query", None) if _parses(sess, text) else (
                "parse", "ParseException", None)
        df = sess.sql(text)
        names = [f"c{i}" for i in range(len(df.columns))]
        cells = ", ".join(f"coalesce(CAST({c} AS STRING), '')" for c in names)
        return "ok", None, df.toDF(*names).select(F.expr(f"array({cells})").alias("row"), F.lit(sid).alias("stmt_id"))
    except ParseException as e:
        return "parse", type(e).__name__, None
    except AnalysisException as e:
        return "execution", getattr(e, "getCondition", lambda: None)() or type(e).__name__, None


def plan_statements(spark: SparkSession, statements: DataFrame, work: str, sql_col: str = "sql",
                    db_col: str | None = None, batch_size: int = BATCH_SIZE) -> tuple[str, int]:
    """(work table, number of batches). Written once for a work folder; its one-row plan commits it."""
    plan = f"{work}/plan"
    try:
        row = spark.read.schema(PLAN_SCHEMA).parquet(plan).first()
        if row is not None:
            return row["todo"], row["batches"]
    except AnalysisException:
        pass  # no such folder yet
    db = F.col(db_col) if db_col else F.lit(None).cast("string")
    distinct = statements.select(statement_id(sql_col, db_col).alias("stmt_id"), db.alias("db"),
                                 F.coalesce(clean_sql(sql_col), F.lit("")).alias("text")).dropDuplicates(["stmt_id"])
    # batches run along the databases, so that a batch needs few sessions
    ranked = exact_rank(distinct, [F.col("db").asc_nulls_first(), F.col("stmt_id")], "place")
    batch = F.floor((F.col("place") - 1) / batch_size)
    todo = f"{work}/todo-{uuid.uuid4().hex[:8]}"
    ranked.select("stmt_id", "db", "text", batch.alias("batch"), F.floor(batch / WINDOW).alias("window")).repartitionByRange(
        "window").write.partitionBy("window").parquet(todo)
    last = spark.read.schema(TODO_SCHEMA).parquet(todo).agg(F.max("batch")).first()[0]
    batches = 0 if last is None else last + 1
    spark.createDataFrame([], ROWS_SCHEMA).write.mode("overwrite").partitionBy("tag").parquet(f"{work}/rows")
    spark.createDataFrame([], STATUS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{work}/status/batch=-1")
    spark.createDataFrame([(todo, batches)], PLAN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(plan)
    return todo, batches


def _literal_rows(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few rows as one literal in one partition; needs no Python worker, as ``createDataFrame`` does."""
    text = json.dumps([dict(zip(schema.names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), ArrayType(schema))))


def _statuses(spark: SparkSession, work: str) -> DataFrame:
    return spark.read.schema(StructType([*STATUS_SCHEMA.fields, StructField("batch", LongType())])).parquet(
        f"{work}/status").where("batch >= 0")


def run_statements(spark: SparkSession, statements: DataFrame, sql_col: str = "sql",
                   max_workers: int = 8, timeout_s: float | None = None,
                   work: str | None = None, batch_size: int = BATCH_SIZE,
                   db_col: str | None = None, tables_for=None,
                   scheduler_pool: str = "textsql-statements",
                   max_batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run every distinct cleaned statement (per database when ``db_col`` is given) once.

    A batch's statements are analysed by threads of their own. Its runnable ones go out as one Spark job a
    database; a job that fails is run again in halves, down to one statement a job, so that the failure is
    pinned to its statement. Batches run concurrently from a bounded pool; each job group is cancelled after
    ``timeout_s`` (off by default). Statements see the
    caller's views, or with ``db_col`` that database's tables (``tables_for(session, db_id) -> {name:
    DataFrame}``) or catalog database. ``work`` names a folder to go on in; ``max_batches`` ends the call
    after so many batches, for a later call with the same folder.

    Returns ``(status, rows)`` of the committed batches: status (stmt_id, status, error) and rows (stmt_id,
    row array<string>) with NULL cells as ''. ``stmt_id`` = ``statement_id(sql, db)``.
    """
    work = (work or scratch_path(spark, "statements")).rstrip("/")
    todo, batches = plan_statements(spark, statements, work, sql_col, db_col, batch_size)
    sc = spark.sparkContext
    sessions = _Sessions(spark, tables_for)

    def write(frames: list[DataFrame], tag: str) -> str | None:
        group = f"textsql-{uuid.uuid4().hex[:8]}"
        timer = None
        try:
            sc.setJobGroup(group, f"statements {tag}", interruptOnCancel=True)
            # Concurrent batches share executors fairly when the cluster runs the FAIR scheduler.
            sc.setLocalProperty("spark.scheduler.pool", scheduler_pool)
            if timeout_s:
                timer = threading.Timer(timeout_s, lambda: sc.cancelJobGroup(group))
                timer.start()
            u = frames[0]
            for df in frames[1:]:
                u = u.unionByName(df)
            u.write.parquet(f"{work}/rows/tag={tag}")
            return None
        except Exception as e:  # noqa: BLE001 - runtime failure of a statement in the batch
            return type(e).__name__
        finally:
            if timer is not None:
                timer.cancel()

    def run_items(items: list, tag: str) -> list[tuple]:
        err = write([df for _, df in items], tag)
        if err is None:
            return [(sid, "ok", None, tag) for sid, _ in items]
        if len(items) == 1:
            return [(items[0][0], "execution", err, None)]
        half = len(items) // 2
        return run_items(items[:half], f"{tag}-0") + run_items(items[half:], f"{tag}-1")

    def run_batch(item) -> None:
        batch, texts = item
        attempt = f"{batch}-{uuid.uuid4().hex[:8]}"
        status, by_db = [], {}
        analyzed = analysts.map(lambda t: _analyze(sessions.get(t[1]), t[0], t[2]), texts)
        for (sid, db, _), (st, err, df) in zip(texts, analyzed):
            if st == "ok":
                by_db.setdefault(db, []).append((sid, df))
            else:
                status.append((sid, st, err, None))
        for i, items in enumerate(by_db.values()):
            status += run_items(items, f"{attempt}-{i}")
        # the commit: one file, in place or not at all
        _literal_rows(spark, status, STATUS_SCHEMA).write.mode("overwrite").parquet(f"{work}/status/batch={batch}")

    left = batches if max_batches is None else max_batches
    analysts = ThreadPoolExecutor(max_workers=ANALYSTS * max_workers, thread_name_prefix=_ANALYST)
    PySparkLogger.getLogger("SQLQueryContextLogger").addFilter(_not_of_analysts)  # the same filter is added once
    try:
        # both folders are listed once; a window's batches are written by this call alone
        done = {r["batch"] for r in _statuses(spark, work).select("batch").distinct().collect()}
        listed = spark.read.schema(TODO_SCHEMA).parquet(todo)
        for window in range(-(-batches // WINDOW)):
            first = window * WINDOW
            if done.issuperset(range(first, min(first + WINDOW, batches))):
                continue
            texts: dict[int, list] = {}
            for r in listed.where(F.col("window") == window).collect():
                if r["batch"] not in done:
                    texts.setdefault(r["batch"], []).append((r["stmt_id"], r["db"], r["text"]))
            now = sorted(texts.items())[:left]
            left -= len(now)
            with ThreadPoolExecutor(max_workers=max_workers) as pool:
                list(pool.map(run_batch, now))
            if left <= 0:
                break
    finally:
        analysts.shutdown(cancel_futures=True)
        sessions.close()
    status = _statuses(spark, work)
    rows = spark.read.schema(ROWS_SCHEMA).parquet(f"{work}/rows")
    kept = status.where("status = 'ok'").select("stmt_id", "tag")
    return status.select("stmt_id", "status", "error"), rows.join(kept, ["stmt_id", "tag"], "left_semi").select("stmt_id", "row")


def score_pairs(spark: SparkSession, pairs: DataFrame, key: str = "pair_id", gold_col: str = "gold_sql",
                pred_col: str = "pred_sql", db_col: str | None = None, **run_kw) -> DataFrame:
    """Execute gold and prediction once per distinct (database, statement), compare them as row
    multisets, and attach status and failure mode. With ``db_col`` both statements of a pair run
    against that pair's database.

    Statements are sorted into classes of equal results first (``multiset_classes``), so their rows are
    read the same number of times however many pairs there are; a pair matches if its statements share a class.

    Output: key, gold_status, pred_status, exec_match, failure_mode.
    """
    from ..functions.sqltext import classify_failure

    p = pairs.select(key, statement_id(gold_col, db_col).alias("gold_id"),
                     statement_id(pred_col, db_col).alias("pred_id"), F.col(pred_col).alias("__pred_text"))
    dbs = [db_col] if db_col else []
    stmts = pairs.select(*dbs, F.col(gold_col).alias("sql")).unionByName(
        pairs.select(*dbs, F.col(pred_col).alias("sql")))
    status, rows = run_statements(spark, stmts, "sql", db_col=db_col, **run_kw)
    classes, doubtful = multiset_classes(rows, status.where("status = 'ok'").select("stmt_id"), "stmt_id")
    known = status.join(classes, "stmt_id", "left").select("stmt_id", "status", "class_id")
    g = known.toDF("gold_id", "gold_status", "gold_class")
    r = known.toDF("pred_id", "pred_status", "pred_class")
    combos = p.select("gold_id", "pred_id").distinct().join(g, "gold_id").join(r, "pred_id")
    match = F.coalesce(F.col("gold_class") == F.col("pred_class"), F.lit(False))
    if doubtful is not None:  # digests that tie for different rows: those pairs are compared row by row
        both = combos.where(match & (F.col("gold_id") != F.col("pred_id"))).join(
            doubtful.withColumnRenamed("class_id", "gold_class"), "gold_class", "left_semi").select("gold_id", "pred_id")
        both = maybe_broadcast(both, max_rows=100_000, row_bytes=160)
        eq = multiset_equal(both.join(rows.withColumnRenamed("stmt_id", "gold_id"), "gold_id"),
                            both.join(rows.withColumnRenamed("stmt_id", "pred_id"), "pred_id"),
                            key=["gold_id", "pred_id"], keys=both, out_col="__eq")
        combos = combos.join(eq, ["gold_id", "pred_id"], "left")
        match = match & F.coalesce(F.col("__eq"), F.lit(True))
    out = p.join(combos.withColumn("exec_match", match), ["gold_id", "pred_id"])
    return out.select(
        key, "gold_status", "pred_status", "exec_match",
        classify_failure(F.col("__pred_text"), F.col("pred_status").isin("ok", "execution"),
                         F.col("pred_status") == "ok", F.col("exec_match")).alias("failure_mode"),
    )
