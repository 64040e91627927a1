"""Repeated keys: the last row counts; categories of changes both ways; percent board."""

from __future__ import annotations

from textsql.operators import compare as cmp
from textsql.operators import evaluate as ev

SCHEMA = ("run string, question_id long, db_id string, difficulty string, gold_sql string, pred_sql string, failure_mode string, "
          "exec_match boolean")
GOLD = "SELECT name FROM boats WHERE length > 9"


def row(run, q, ok, pred=GOLD, failure="wrong-result"):
    return (run, q, "harbour", "easy", GOLD, pred, "ok" if ok else failure, ok)


def outcomes(spark):
    rows = [row("a", 1, True), row("a", 1, False, "SELECT name FROM boats"), row("b", 1, False), row("b", 1, True),
            row("a", 2, None, "", "empty"), row("b", 2, True), row("a", 3, True), row("b", 3, False, "SELECT count(name) FROM boats WHERE 1"),
            row("a", 4, True), row("b", 4, True), row("c", 1, False, "oops (", "parse"), row("a", 5, False)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_last_row_wins_without_an_order_column(spark):
    out = outcomes(spark)
    cases = cmp.disagreements(out, "a", "b").collect()
    assert sorted((c.question_id, c.category) for c in cases) == [(1, "missing-filter"), (2, "empty-output")]
    moved = {r.treatment: (r.fixed, r.regressed, r.net) for r in cmp.fixed_regressed(out, "a").collect()}
    assert moved == {"b": (2, 1, 1), "c": (0, 0, 0)}


def test_categories_both_ways(spark):
    got = {(r.treatment, r.direction, r.category): r.n for r in cmp.change_categories(outcomes(spark), "a").collect()}
    assert got == {("b", "fixed", "missing-filter"): 1, ("b", "fixed", "empty-output"): 1, ("b", "regressed", "aggregation-mismatch"): 1}
    assert cmp.change_categories(outcomes(spark), "a", treatments=["c"]).count() == 0


def test_a_database_listed_twice_gives_one_row(spark):
    ex = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "question_id long, db_id string")
    sch = spark.createDataFrame([("x", "old"), ("x", "new"), ("z", "z")], "db_id string, ddl string").coalesce(1)
    got = {r.question_id: (r.ddl, r.has_schema) for r in ev.attach_schemas(ex, sch).collect()}
    assert got == {1: ("new", True), 2: (None, False), 3: (None, False)}
    ordered = spark.createDataFrame([("x", "late", 2), ("x", "early", 1)], "db_id string, ddl string, at int")
    assert [r.ddl for r in ev.attach_schemas(ex, ordered, "at").where("has_schema").collect()] == ["late"]


def test_null_matches_count_as_wrong_everywhere(spark):
    out = outcomes(spark).withColumnRenamed("exec_match", "m").selectExpr("*", "m AS exec_match", "m AS exact_set_match").drop("m")
    board = {r.run: r for r in ev.leaderboard(out).collect()}
    total = {r.run: r.exec_accuracy for r in ev.summarize(out).where("difficulty = 'all'").collect()}
    assert {k: r.exec_accuracy for k, r in board.items()} == total
    shown = ev.percent_board(ev.leaderboard(out)).collect()
    assert [r.run for r in shown] == ["c", "a", "b"]  # ascending
    assert shown[1].exec_accuracy == "50.0%" and shown[2].easy == "60.0%" and shown[0].hard == "0.0%"
