"""X1 in resumable batches, the read-only sessions, and classes of equal results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textsql.operators import execute as ex
from textsql.operators.resultset import multiset_classes


def listed(spark, n=40):
    texts = [f"SELECT id, id * {i} AS x FROM range({i % 7})" for i in range(n)] + ["SELECT nope FROM range(2)", "SELECT (1", ""]
    return spark.createDataFrame([(t,) for t in texts], "sql string")


def outcome(status, rows):
    return (sorted((r.stmt_id, r.status) for r in status.collect()), sorted((r.stmt_id, *r.row) for r in rows.collect()))


def test_a_stopped_run_goes_on_and_ends_equal(spark, tmp_path, monkeypatch):
    stmts = listed(spark)
    whole = outcome(*ex.run_statements(spark, stmts, batch_size=8))
    work, seen, analyze = str(tmp_path / "work"), [], ex._analyze

    def dies(sess, sid, text):
        seen.append(sid)
        if len(seen) > 19:  # inside the third batch
            raise KeyboardInterrupt
        return analyze(sess, sid, text)

    monkeypatch.setattr(ex, "_analyze", dies)
    with pytest.raises(KeyboardInterrupt):
        ex.run_statements(spark, stmts, work=work, batch_size=8, max_workers=1)
    again = []
    monkeypatch.setattr(ex, "_analyze", lambda sess, sid, text: (again.append(sid), analyze(sess, sid, text))[1])
    assert outcome(*ex.run_statements(spark, stmts, work=work, batch_size=8)) == whole
    assert len(again) == 43 - 16 and not set(again) & set(seen[:16])  # two batches were committed
    again.clear()
    assert outcome(*ex.run_statements(spark, stmts, work=work, batch_size=8)) == whole and again == []


def test_unresolved_names_are_looked_up_once(spark, monkeypatch):
    texts = ["SELECT nope FROM range(2)", "SELECT * FROM nowhere", "SELECT no_such(1)", "SELECT * FROM parquet.`/no/where`",
             "SELECT 1 AS a, 2 AS a", "SELECT 'x' || id, NULL, DATE'2024-01-02' FROM range(1)", "SELECT id FROM range(3) WHERE sum(id) > 1"]
    child, calls = ex.read_only_session(spark), []
    want = []
    for text in texts:
        try:
            child.sql(text)
            want.append(("ok", None))
        except ex.AnalysisException as e:
            want.append(("execution", e.getCondition()))
    sql = type(child).sql
    monkeypatch.setattr(type(child), "sql", lambda self, query, *a, **k: (calls.append(query), sql(self, query, *a, **k))[1])
    got = [ex._analyze(child, str(i), text) for i, text in enumerate(texts)]
    assert [g[:2] for g in got] == want and [w[0] for w in want].count("ok") == 2
    assert len(calls) == 2 * len(texts) - 4
    assert [r.row for g in got if g[2] is not None for r in g[2].collect()] == [["1", "2"], ["x0", "", "2024-01-02"]]


def test_status_rows_are_literal(spark):
    rows = [("a", "ok", None, "t-'\"\\\n"), ("b", "execution", "é😀", None)]
    assert [tuple(r) for r in ex._literal_rows(spark, rows, ex.STATUS_SCHEMA).collect()] == rows


def test_max_batches_stops_early(spark, tmp_path):
    status, rows = ex.run_statements(spark, listed(spark), work=str(tmp_path / "w"), batch_size=8, max_batches=2)
    assert status.count() == 16
    status, rows = ex.run_statements(spark, listed(spark), work=str(tmp_path / "w"), batch_size=8)
    assert status.count() == 43


def test_windows_bound_what_the_driver_holds(spark, monkeypatch):
    monkeypatch.setattr(ex, "WINDOW", 2)
    status, rows = ex.run_statements(spark, listed(spark), batch_size=4)
    assert status.count() == 43 and rows.count() == sum(i % 7 for i in range(40))


def test_no_statements(spark):
    status, rows = ex.run_statements(spark, listed(spark).limit(0))
    assert status.count() == 0 and rows.count() == 0


@pytest.mark.parametrize("text", [
    "SELECT java_method('java.lang.Math', 'abs', -1)", "SELECT `reflect`('java.lang.Math', 'abs', -1)",
    "SELECT /* x */ try_reflect/**/('java.lang.Math', 'abs', -1)", "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', -1)",
    "SELECT value FROM text.`{path}`", "SELECT * FROM csv.`{path}`", "CREATE TABLE made_here AS SELECT 1", "SET spark.sql.runSQLOnFiles = true",
    "CACHE TABLE c AS SELECT 1", "SHOW TABLES"])
def test_statements_cannot_reach_files_or_the_jvm(spark, tmp_path, text):
    (tmp_path / "secret.txt").write_text("secret")
    stmts = spark.createDataFrame([(text.format(path=tmp_path / "secret.txt"),), ("SELECT 7",)], "sql string")
    status, rows = ex.run_statements(spark, stmts)
    assert sorted(r.status for r in status.collect()) == ["execution", "ok"] and [r.row for r in rows.collect()] == [["7"]]
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"  # the caller's session is as it was
    assert spark.sql("SELECT reflect('java.lang.Math', 'abs', -1)").first()[0] == "1"


def test_statements_see_the_callers_views(spark):
    spark.range(5).createOrReplaceTempView("callers_view")
    status, rows = ex.run_statements(spark, spark.createDataFrame([("SELECT count(*) FROM callers_view",)], "sql string"))
    assert [r.row for r in rows.collect()] == [["5"]]
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("textsql_")]


def result_rows(spark, sets):
    return spark.createDataFrame([(k, [str(c) for c in row]) for k, rows in sets.items() for row in rows], "k string, row array<string>")


SETS = {"a": [(1, 2), (1, 2), (3, 4)], "b": [(3, 4), (1, 2), (1, 2)], "c": [(1, 2), (3, 4), (3, 4)], "d": [(1, 2), (3, 4)],
        "f": [("12",), ("34",)], "g": [("34",), ("12",)], "h": [("1", "2")], "i": [("12", "")]}


def expected_classes(sets, ids):
    key = {i: tuple(sorted(map(repr, ([str(c) for c in r] for r in sets.get(i, []))))) for i in ids}
    return {i: min(j for j in ids if key[j] == key[i]) for i in ids}


def test_classes_equal_exact_comparison(spark):
    ids = [*SETS, "empty1", "empty2"]
    classes, doubtful = multiset_classes(result_rows(spark, SETS), spark.createDataFrame([(i,) for i in ids], "k string"), "k")
    assert {r.k: r.class_id for r in classes.collect()} == expected_classes(SETS, ids) and doubtful is None


def test_equal_digests_of_different_rows_are_found(spark, monkeypatch):
    from textsql.operators import resultset

    monkeypatch.setattr(resultset, "multiset_digest", lambda rows, key, row_col="row": rows.groupBy(key).agg(
        F.struct(F.count(F.lit(1)).alias("n_rows")).alias("digest")))
    ids = spark.createDataFrame([(i,) for i in SETS], "k string")
    classes, doubtful = multiset_classes(result_rows(spark, SETS), ids, "k")
    assert {r.class_id for r in doubtful.collect()} == {"a", "d", "h"}  # three rows, two rows, one row
    pairs = spark.createDataFrame([(1, "SELECT 1", "SELECT 2"), (2, "SELECT 2", "SELECT 1 + 1")], "pair_id long, gold_sql string, pred_sql string")
    assert {r.pair_id: r.exec_match for r in ex.score_pairs(spark, pairs).collect()} == {1: False, 2: True}


def test_a_refused_function_spoils_no_batch(spark, monkeypatch):
    """a refused function fails when its statement is analysed, so that the batch's other statements run in one job."""
    from pyspark.sql.readwriter import DataFrameWriter

    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    texts = [f"SELECT {i}" for i in range(6)] + ["SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT try_reflect()"]
    status, rows = ex.run_statements(spark, spark.createDataFrame([(t,) for t in texts], "sql string"), batch_size=8)
    assert sorted(r.status for r in status.collect()) == ["execution"] * 2 + ["ok"] * 6 and rows.count() == 6
    assert len([p for p in written if "/rows/tag=" in p]) == 1


def test_a_failing_job_is_halved(spark, monkeypatch):
    """one statement of sixteen fails when it runs: halves are run again, not every statement by itself."""
    from pyspark.sql.readwriter import DataFrameWriter

    written, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    texts = [f"SELECT {i} AS a" for i in range(15)] + ["SELECT raise_error('no')"]
    status, rows = ex.run_statements(spark, spark.createDataFrame([(t,) for t in texts], "sql string"), batch_size=16)
    assert sorted(r.status for r in status.collect()) == ["execution"] + ["ok"] * 15
    assert sorted(int(r.row[0]) for r in rows.collect()) == list(range(15))
    assert len([p for p in written if "/rows/tag=" in p]) == 9  # 16, then two of 8, 4, 2 and 1


@pytest.mark.parametrize("text,status", [
    ("SELECT 1) INSERT INTO kept_apart (a", "parse"), ("SELECT 1), (SELECT 2", "parse"), ("SELECT 1; ;", "ok"), ("SELECT 1 -- )", "ok"),
    ("SELECT ')' AS a", "ok"), ("SELECT 1 AS a, 2 AS a", "ok"), ("VALUES (1), (2)", "ok"), ("SHOW tables", "execution"), ("tables", "parse"),
    ("WITH x AS (SELECT 1 AS a) SELECT a FROM x ORDER BY a LIMIT 1", "ok"), ("FROM range(2) SELECT id", "ok")])
def test_what_is_a_query(spark, text, status):
    got, _ = ex.run_statements(spark, spark.createDataFrame([(text,)], "sql string"))
    assert [r.status for r in got.collect()] == [status]
