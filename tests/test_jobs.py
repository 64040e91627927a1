"""End-to-end jobs over the tram database."""

from __future__ import annotations

from tests.named import TRAM_ROWS
from textsql.plans.jobs import evaluate_runs, generate_traces


def tables_of(sess, db):
    return {name: sess.createDataFrame(rows, schema) for name, (rows, schema) in TRAM_ROWS.items()}


def test_runs_are_scored_in_one_pass(spark, tram_examples):
    ex = tram_examples.collect()
    preds = spark.createDataFrame(
        [("as asked", r.question_id, f" {r.query} ;") for r in ex] + [("silent", r.question_id, "") for r in ex]
        + [("poor", 0, "SELECT (district FROM depot"), ("poor", 1, "SELECT max(chairs) FROM car"), ("poor", 2, "SELECT district, 0 FROM depot")]
        + [("other words", 0, "SELECT d.district FROM depot AS d"), ("other words", 1, "SELECT seats FROM car ORDER BY seats DESC LIMIT 1")],
        "run string, question_id long, predicted_sql string")
    outcomes, summary = evaluate_runs(spark, tram_examples, preds, tables_for=tables_of)
    s = {(r.run, r.difficulty): r for r in summary.collect()}
    assert (s["as asked", "all"].exec_accuracy, s["as asked", "all"].exact_match_accuracy) == (1.0, 1.0)
    assert (s["other words", "all"].exec_accuracy, s["other words", "all"].exact_match_accuracy) == (1.0, 0.0)
    assert s["silent", "all"].exec_accuracy == s["poor", "all"].exec_accuracy == 0.0
    modes = {(r.run, r.question_id): r.failure_mode for r in outcomes.collect()}
    assert [modes["poor", i] for i in range(3)] == ["parse", "execution", "wrong-result"]
    assert [modes["silent", i] for i in range(3)] == ["empty"] * 3


def test_traces_take_the_candidate_that_agrees_with_gold(spark, tram_examples):
    ex = tram_examples.collect()
    answers = [(r.question_id, 0, "Perhaps\n```sql\nSELECT fleet_no FROM car WHERE fleet_no < 0\n```") for r in ex]
    answers += [(r.question_id, 1, f"Step by step.\n```sql\n{r.query};\n```") for r in ex]
    fmt = "question_id long, sample_index long, text string"
    modes = spark.createDataFrame([(2, "reasoning"), (0, "direct"), (1, "direct")], "question_id long, mode string")
    names = spark.createDataFrame([("trams", ["depot", "car"])], "db_id string, tables array<string>")
    traces, funnel, reasons = generate_traces(spark, tram_examples, spark.createDataFrame(answers, fmt), modes, names, tables_for=tables_of)
    t = {r.question_id: r for r in traces.collect()}
    assert {i: (r.sql, r.n_candidates, r.matched_gold) for i, r in t.items()} == {r.question_id: (r.query, 2, True) for r in ex}
    assert t[2].reasoning == "Step by step." and t[0].reasoning is None
    f = funnel.first()
    assert (f.examples_kept, f.candidates_total, f.candidates_match_gold) == (3, 6, 3)

    mute = spark.createDataFrame([(r.question_id, i, "I can't say") for r in ex for i in range(2)], fmt)
    traces, funnel, reasons = generate_traces(spark, tram_examples, mute, modes, names, tables_for=tables_of)
    assert traces.count() == 0 and {r.drop_reason: r.n for r in reasons.collect()} == {"no-executable": 3}
