"""Round trips of the sinks and hooks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from textsql import schemas as SC
from textsql.operators import evaluate as ev
from textsql.operators.compare import anchor_run, merge_runs, results_document
from textsql.operators.datasets import length_filter, read_jsonl, tokenizer_counter
from textsql.operators.ledger import misses, replay, write_store
from textsql.operators.traces import read_ordered_traces, write_ordered_traces, write_stats, write_traces
from textsql.sources.files import read_outcomes, read_traces, write_outcomes


def test_traces_round_trip_and_corrupt_quarantine(spark, tmp_path):
    rows = [(2, "trams", "q2", "", "direct", "select 2", None, "SELECT 2", 3, True),
            (1, "trams", "q1", "", "reasoning", "select 1", "why", "SELECT 1", 3, False)]
    t = spark.createDataFrame(rows, SC.TRACE)
    write_traces(t, str(tmp_path / "traces"))
    (tmp_path / "traces" / "part-bad.json").write_text('{"question_id": 9, oops\n\n')
    back = read_traces(spark, str(tmp_path / "traces"))
    rows = back.select("question_id", "mode", "_corrupt_record").collect()
    assert sorted(r.question_id for r in rows if r._corrupt_record is None) == [1, 2]
    assert sum(1 for r in rows if r._corrupt_record is not None) == 1


def test_ordered_traces_round_trip(spark, tmp_path):
    rows = [(i, "trams", f'q"{i}\n\u00e9', "", "direct" if i % 2 else "reasoning", f"select {i}", None if i % 2 else "why", "SELECT 2", 3, i % 3 == 0)
            for i in range(50)]
    t = spark.createDataFrame(rows, SC.TRACE)
    for commit in (1, 2):
        assert write_ordered_traces(t.repartition(5), str(tmp_path / "t"), rows_per_file=8) == commit
    back = read_ordered_traces(spark, str(tmp_path / "t")).orderBy("line_no").collect()
    assert [tuple(r) for r in back] == [(i + 1, *r) for i, r in enumerate(rows)]


def test_stats_document(spark, tmp_path):
    funnel = spark.createDataFrame([(3, 1, 2)], "examples_seen long, examples_kept long, examples_dropped long")
    reasons = spark.createDataFrame([("no-match", 2)], "drop_reason string, n long")
    write_stats(funnel, reasons, 0.123456, str(tmp_path / "stats"))
    doc = json.loads(next((tmp_path / "stats").glob("part-*.json")).read_text())
    assert doc["drop_reasons"] == {"no-match": 2} and doc["cost_usd"] == 0.1235


def test_outcomes_keep_raw_prediction(spark, tmp_path):
    o = spark.createDataFrame([("a", 1, "db", "easy", "SELECT 1", "SELECT 1", True, True, "ok")],
                              "run string, question_id long, db_id string, difficulty string, gold_sql string, "
                              "pred_sql string, exec_match boolean, exact_set_match boolean, failure_mode string")
    p = spark.createDataFrame([("a", 1, "  SELECT 1; ")], "run string, question_id long, predicted_sql string")
    write_outcomes(o, p, str(tmp_path / "out"))
    back = read_outcomes(spark, str(tmp_path / "out"), runs=["a"]).first()
    assert back.pred_sql == "  SELECT 1; " and back.run == "a"


def test_response_store_replay(spark, tmp_path):
    store = spark.createDataFrame([("ab12", "```sql\nSELECT 1\n```", 10, 5)],
                                  "key string, text string, prompt_tokens long, completion_tokens long")
    write_store(store, str(tmp_path / "store"))
    s = spark.read.parquet(str(tmp_path / "store"))
    assert s.filter("key_prefix = 'ab'").count() == 1
    req = spark.createDataFrame([("ab12",), ("cd34",)], "key string")
    r = {x.key: x.cached for x in replay(req, s).collect()}
    assert r == {"ab12": True, "cd34": False}
    assert [x.key for x in misses(req, s).collect()] == ["cd34"]


def test_results_document_and_merge(spark):
    o = spark.createDataFrame([("a", 1, "easy", True, False), ("b", 1, "hard", False, False)],
                              "run string, question_id long, difficulty string, exec_match boolean, exact_set_match boolean")
    s = ev.summarize(o)
    docs = {r.run: json.loads(r.summary_json) for r in results_document(s).collect()}
    assert docs["a"]["exec_accuracy"] == 1.0 and docs["a"]["by_difficulty"]["easy"]["n"] == 1.0
    new = s.filter("run = 'b'").withColumn("n", F.lit(99).cast("bigint"))
    merged = {(r.run, r.difficulty): r.n for r in merge_runs(s, new).collect()}
    assert merged[("b", "all")] == 99 and merged[("a", "all")] == 1
    runs = spark.createDataFrame([("student_primary",), ("teacher_ref",), ("student_x",)], "run string")
    assert anchor_run(runs, "^student_.*primary").first().run == "student_primary"
    assert anchor_run(runs, "^nothing").count() == 0


def test_value_checks_quarantine(spark):
    df = spark.createDataFrame([("ok-run_1", 0.4, "lora"), ("bad run", 1.5, "gpt")], "run string, share double, kind string")
    good, bad = SC.split_valid(df, SC.checks("run", "share", "kind"))
    assert [r.run for r in good.collect()] == ["ok-run_1"]
    assert bad.first().failed_checks == ["run_name_ok", "share_ok", "kind_ok"]


def test_tokenizer_hook(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "text string")
    count = tokenizer_counter(lambda texts: [len(t.split()) for t in texts])
    got = [r.n_tokens for r in length_filter(df, F.col("text"), max_tokens=2, tokens=count("text")).collect()]
    assert got == [3, 0]


def test_read_jsonl_skips_blank_lines(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"question_id": 1, "db_id": "trams", "predicted_sql": "SELECT 1"}\n\n'
                 '{"question_id": 2, "db_id": "trams", "predicted_sql": null}\n')
    df = read_jsonl(spark, str(p), SC.PREDICTION)
    assert df.count() == 2


def test_ledger_append_and_reload(spark, tmp_path):
    from textsql.operators.ledger import append_ledger, call_cost, load_spend

    df = spark.createDataFrame([(1, 1000, 100), (1, 2000, 0)], "ledger long, in_tokens long, out_tokens long")
    append_ledger(df, call_cost("in_tokens", "out_tokens"), str(tmp_path / "led"), "run1")
    append_ledger(df, call_cost("in_tokens", "out_tokens"), str(tmp_path / "led"), "run2")
    r = load_spend(spark, str(tmp_path / "led"), cap_usd=0.001).first()
    assert abs(r.spend_usd - 2 * (3000 * 0.15e-6 + 100 * 0.6e-6)) < 1e-9
    assert r.remaining_usd == max(0.0, 0.001 - r.spend_usd)


def test_overlay_all_buckets(spark):
    o = spark.createDataFrame([("a", 1, "easy", True, False)],
                              "run string, question_id long, difficulty string, exec_match boolean, exact_set_match boolean")
    s = ev.summarize(o)
    off = spark.createDataFrame([("a", "execution", "hard", 0.5)], "run string, metric string, bucket string, value double")
    got = {r.difficulty: (r.n, r.exec_overlay) for r in ev.overlay_metrics(s, off, all_buckets=True).collect()}
    assert got["easy"] == (1, 1.0) and got["hard"] == (0, 0.5) and got["extra"] == (0, None) and "all" in got


def test_completion_hook_only_misses(spark, tmp_path):
    import pandas as pd

    from textsql.operators.ledger import complete_with

    store = spark.createDataFrame([("k1", "```sql\nSELECT 1\n```", 1, 1)],
                                  "key string, text string, prompt_tokens long, completion_tokens long")
    req = spark.createDataFrame([("k1", "q one"), ("k2", "q two")], "key string, messages_text string")

    def client(pdf):
        return pd.DataFrame({"text": "```sql\nSELECT 2\n```", "prompt_tokens": pdf["messages_text"].str.len(),
                             "completion_tokens": 3})

    new = complete_with(misses(req, store), client)
    write_store(store.unionByName(new), str(tmp_path / "s"))
    back = {r.key: r.text for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert back == {"k1": "```sql\nSELECT 1\n```", "k2": "```sql\nSELECT 2\n```"}


def test_offline_prediction_values(spark, tmp_path):
    from textsql.sources.files import read_predictions_jsonl

    p = tmp_path / "pred.jsonl"
    p.write_text('{"question_id": 1, "db_id": "trams", "predicted_sql": "SELECT 1"}\n\n'
                 '{"question_id": 2, "db_id": "trams", "predicted_sql": null}\n'
                 '{"question_id": 3, "db_id": "trams"}\n')
    got = {r.question_id: r.predicted_sql for r in read_predictions_jsonl(spark, str(p)).collect()}
    assert got == {1: "SELECT 1", 2: "None", 3: ""}


def test_bucketed_store_upserts_and_replays_without_moving_the_store(spark, tmp_path):
    from textsql.sources.store import missing_requests, open_store, replay_store, upsert_responses

    def rows(lo, hi, word, at):
        return spark.range(lo, hi).selectExpr("sha2(cast(id AS string), 256) AS key", f"concat('{word}', id) AS text", "id AS prompt_tokens",
                                              "1L AS completion_tokens", f"timestamp_seconds({at}) AS saved_at")

    path = str(tmp_path / "responses")
    open_store(spark, "store_a", path, buckets=4, prefix_chars=1)
    for _ in range(2):  # a repeated write
        upsert_responses(spark, "store_a", rows(0, 100, "old", 10))
    upsert_responses(spark, "store_a", rows(90, 120, "new", 20))
    upsert_responses(spark, "store_a", rows(0, 5, "stale", 5))
    upsert_responses(spark, "store_a", rows(0, 0, "none", 5))
    open_store(spark, "store_b", path, buckets=4, prefix_chars=1)  # the same files under another name
    got = {r.prompt_tokens: r.text for r in spark.table("store_b").collect()}
    assert got == {i: f"new{i}" if i >= 90 else f"old{i}" for i in range(120)}
    req = spark.range(60, 180, 2).selectExpr("sha2(cast(id AS string), 256) AS key", "id")
    out = replay_store(spark, req, "store_a")
    assert {r.id: (r.cached, r.text) for r in out.collect()} == {i: (i < 120, got.get(i, "")) for i in range(60, 180, 2)}
    assert sorted(r.id for r in missing_requests(spark, req, "store_a").collect()) == list(range(120, 180, 2))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the requests' own
    with pytest.raises(Exception, match="without a key"):
        upsert_responses(spark, "store_a", rows(0, 1, "x", 1).withColumn("key", F.lit(None).cast("string")))


def test_repeated_file_write_keeps_one_row_a_key(spark, tmp_path):
    rows = spark.createDataFrame([("ab1", "x", 1, 2), ("cd2", "y", 3, 4)], "key string, text string, prompt_tokens long, completion_tokens long")
    for _ in range(2):
        write_store(rows, str(tmp_path / "s"))
    write_store(rows.where("key = 'ab1'").withColumn("text", F.lit("z")), str(tmp_path / "s"))
    assert sorted((r.key, r.text) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("ab1", "z"), ("cd2", "y")]


def test_small_costs_add_up(spark, tmp_path):
    from textsql.operators.ledger import append_ledger, call_cost, load_spend

    calls = spark.range(1000).selectExpr("1L AS ledger", "2L AS in_tokens", "0L AS out_tokens")
    for run in ("a", "b", "b"):  # a retried run replaces itself
        append_ledger(calls, call_cost("in_tokens", "out_tokens"), str(tmp_path / "led"), run)
    r = load_spend(spark, str(tmp_path / "led"), 1.0).first()
    assert (r.spend_usd, r.remaining_usd) == (0.0006, 0.9994)
