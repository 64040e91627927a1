from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from textsql.operators import evaluate as ev
from textsql.operators.resultset import multiset_equal, normalize_row


def rows(spark, qid, data):
    df = spark.createDataFrame([(qid, a, b) for a, b in data], "question_id long, a long, b string")
    return df.select("question_id", normalize_row("a", "b").alias("row"))


def test_multiset_equal_nulls_order_and_duplicates(spark):
    a = [(7, None), (None, "Fields"), (7, None), (9, "Harbour")]
    g = rows(spark, 1, a).unionByName(rows(spark, 2, a)).unionByName(rows(spark, 3, a))
    p = rows(spark, 1, a[2:] + a[:2]).unionByName(rows(spark, 2, a[1:])).unionByName(rows(spark, 3, a[1:] + a[3:]))
    got = {r.question_id: r.exec_match for r in multiset_equal(g, p).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_multiset_null_equals_empty_string_and_empty_sets(spark):
    g = rows(spark, 4, [(None, "x"), (2, None)])
    p = rows(spark, 4, [(2, ""), (None, "x")])
    keys = spark.createDataFrame([(4,), (5,)], "question_id long")
    got = {r.question_id: r.exec_match for r in multiset_equal(g, p, keys=keys).collect()}
    assert got == {4: True, 5: True}  # 5 has no rows on either side


def test_multiset_symmetric(spark):
    g = rows(spark, 6, [(3, "x"), (3, "x"), (4, "y")])
    p = rows(spark, 6, [(3, "x"), (4, "y"), (4, "y")])
    assert multiset_equal(g, p).first().exec_match is False
    assert multiset_equal(p, g).first().exec_match is False


def outcomes(spark):
    data = [
        ("r", 0, "easy", True, True, "ok"),
        ("r", 1, "easy", False, False, "parse"),
        ("r", 2, "hard", True, False, "ok"),
        ("r", 3, "hard", False, False, "empty"),
    ]
    return spark.createDataFrame(data, "run string, question_id long, difficulty string, exec_match boolean, "
                                       "exact_set_match boolean, failure_mode string")


def test_summary_values(spark):
    s = {r.difficulty: r for r in ev.summarize(outcomes(spark)).collect()}
    assert s["all"].n == 4 and s["all"].exec_accuracy == 0.5 and s["all"].exact_match_accuracy == 0.25
    assert s["easy"].exec_accuracy == 0.5 and s["hard"].exec_accuracy == 0.5


def test_failure_breakdown_fixed_modes(spark):
    r = ev.failure_breakdown(outcomes(spark)).first()
    assert (r.ok, r.parse, r.empty, r.execution, r.wrong_result, r.total) == (2, 1, 1, 0, 0, 4)


def test_leaderboard_missing_bucket_is_zero(spark):
    r = ev.leaderboard(outcomes(spark)).first()
    assert r.medium == 0.0 and r.extra == 0.0 and r.easy == 0.5


def test_join_predictions_unknown_id_raises(spark, tram_examples):
    preds = spark.createDataFrame([(999, "trams", "SELECT 1")], "question_id long, db_id string, predicted_sql string")
    with pytest.raises(Exception, match="no example for question_id 999"):
        ev.join_predictions(preds, tram_examples).collect()


def test_last_wins(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k long, v string, pos long")
    got = {r.k: r.v for r in ev.last_wins(df, "k", "pos").collect()}
    assert got == {1: "b", 2: "c"}


def test_printout_round_trip(spark):
    s = ev.summarize(outcomes(spark))
    lines = ev.evaluator_printout(s)
    parsed = {(r.metric, r.bucket): r.value for r in ev.parse_evaluator_printout(lines, pos_col="line_no").collect()}
    assert parsed[("execution", "all")] == 0.5 and parsed[("exact match", "all")] == 0.25
    assert parsed[("execution", "medium")] == 0.0


def test_printout_missing_metric_raises(spark):
    lines = spark.createDataFrame([("r", 1, "execution 0.5 0.5 0.5 0.5 0.5")], "run string, line_no int, value string")
    with pytest.raises(Exception, match="lacks execution"):
        ev.parse_evaluator_printout(lines, pos_col="line_no").collect()


def test_evaluator_lines(spark, tram_examples):
    preds = spark.createDataFrame([(0, "  SELECT\n1 "), (1, "   ")], "question_id long, predicted_sql string")
    got = {r.question_id: r.line for r in ev.evaluator_pred_lines(preds).collect()}
    assert got == {0: "SELECT 1", 1: "SELECT 1"}
    gold = {r.question_id: r.line for r in ev.evaluator_gold_lines(tram_examples).collect()}
    assert gold[0] == "SELECT district FROM depot ORDER BY district\ttrams"


def test_predict_with_python_hook(spark, tram_examples):
    def fn(pdf):
        return "SELECT seats FROM car WHERE fleet_no = " + pdf["question_id"].astype(str)

    out = {r.question_id: r.predicted_sql for r in ev.predict_with(tram_examples, fn).collect()}
    assert out[2] == "SELECT seats FROM car WHERE fleet_no = 2"
    assert ev.predict_empty(tram_examples).filter("predicted_sql <> ''").count() == 0
    assert {r.predicted_sql for r in ev.predict_gold(tram_examples).collect()} == {r.query for r in tram_examples.collect()}


def test_summary_empty_run_gives_zeros(spark):
    runs = spark.createDataFrame([("r",), ("never_ran",)], "run string")
    s = {(r.run, r.difficulty): r for r in ev.summarize(outcomes(spark), runs=runs).collect()}
    z = s[("never_ran", "all")]
    assert (z.n, z.exec_accuracy, z.exact_match_accuracy) == (0, 0.0, 0.0)
    assert s[("r", "all")].n == 4


def test_missing_runs_flagged(spark):
    from textsql.operators.compare import fixed_regressed

    runs = spark.createDataFrame([("r",), ("gone",)], "run string")
    fb = {r.run: r for r in ev.failure_breakdown(outcomes(spark), runs=runs).collect()}
    assert fb["gone"].missing and fb["gone"].total == 0 and not fb["r"].missing
    o = outcomes(spark).unionByName(outcomes(spark).withColumn("run", F.lit("base")))
    fr = {r.treatment: r for r in fixed_regressed(o, "base", treatments=["r", "gone"]).collect()}
    assert fr["gone"].missing and not fr["r"].missing and fr["r"].fixed == 0
