from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textsql.operators import datasets as DS
from textsql.operators.traces import candidate_funnel, drop_reasons, select_candidates

CAND_SCHEMA = "question_id long, sample_index long, sql string, parses_ok boolean, executes_ok boolean, matches_gold boolean"


def select(spark, cands, **kw):
    qs = spark.createDataFrame([(1, "trams", True, True)], "question_id long, db_id string, gold_ok boolean, has_schema boolean")
    tables = spark.createDataFrame([("trams", ["depot", "car"])], "db_id string, tables array<string>")
    c = spark.createDataFrame(cands, CAND_SCHEMA)
    return select_candidates(qs, c, tables, **kw).first()


def test_prefers_matching_candidate(spark):
    r = select(spark, [(1, 0, "SELECT 1 FROM car", True, True, False), (1, 1, "SELECT 2 FROM car", True, True, True)])
    assert r.kept and r.chosen_index == 1 and r.matched_gold


def test_no_match_without_fallback(spark):
    r = select(spark, [(1, 0, "SELECT 1 FROM car", True, True, False)], fallback_executes_only=False)
    assert not r.kept and r.drop_reason == "no-match"


def test_fallback_first_executable(spark):
    r = select(spark, [(1, 0, "SELECT x", False, False, False), (1, 1, "SELECT 1 FROM car", True, True, False)])
    assert r.kept and r.chosen_index == 1 and not r.matched_gold


def test_ungrounded_dropped(spark):
    r = select(spark, [(1, 0, "SELECT * FROM ghost", True, True, True)])
    assert r.drop_reason == "ungrounded"


def test_all_garbage_dropped(spark):
    r = select(spark, [(1, 0, None, False, False, False), (1, 1, "junk", False, False, False)])
    assert r.drop_reason == "no-executable"


def test_pool_first_when_match_not_required(spark):
    r = select(spark, [(1, 0, "SELECT 1 FROM car", True, False, False)], require_matches_gold=False,
               require_executes=False)
    assert r.kept and r.chosen_index == 0


def test_funnel_and_reasons(spark):
    qs = spark.createDataFrame([(1, "trams", True, True), (2, "trams", False, True), (3, "nope", True, False),
                                (4, "trams", True, True)], "question_id long, db_id string, gold_ok boolean, has_schema boolean")
    c = spark.createDataFrame([(1, 0, "SELECT 1 FROM car", True, True, True), (2, 0, "SELECT 1", True, True, True)],
                              CAND_SCHEMA)
    sel = select_candidates(qs, c)
    f = candidate_funnel(sel, c).first()
    assert (f.examples_seen, f.examples_kept, f.examples_dropped, f.candidates_total) == (4, 1, 3, 1)
    reasons = {r.drop_reason: r.n for r in drop_reasons(sel).collect()}
    assert reasons == {"gold-failed": 1, "missing-schema": 1, "no-candidates": 1}


def traces(spark, n=20):
    return spark.createDataFrame([(i, "reasoning" if i % 2 else "direct") for i in range(n)],
                                 "question_id long, mode string")


def test_split_sizes_exact(spark):
    s = DS.train_val_split(traces(spark), split=0.2)
    got = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert got == {"train": 16, "val": 4}
    head = DS.train_val_split(traces(spark), split=0.2, head=True).filter("split = 'val'")
    assert sorted(r.question_id for r in head.collect()) == [0, 1, 2, 3]


def test_direct_only(spark):
    assert DS.direct_only(traces(spark)).count() == 10
    assert DS.direct_only(traces(spark), blank_reasoning=True).count() == 20


def test_assign_modes_exact_share(spark):
    df = spark.range(1001).withColumnRenamed("id", "question_id")
    m = DS.assign_modes(df, share=0.4)
    assert m.filter("mode = 'reasoning'").count() == round(0.4 * 1001)
    again = DS.assign_modes(df, share=0.4)
    assert m.exceptAll(again).count() == 0  # seeded: reproducible


def test_length_batches(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(10)], "question_id long, n long")
    b = DS.length_batches(df, "n", 4).orderBy("position").collect()
    assert [r.position for r in b] == list(range(1, 11))
    assert [r.batch_id for r in b] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert [r.n for r in b] == sorted(r.n for r in b)


def test_api_error_reason_and_funnel(spark):
    qs = spark.createDataFrame([(1, "trams", True, True, None), (2, "trams", True, True, "RateLimitError")],
                               "question_id long, db_id string, gold_ok boolean, has_schema boolean, api_error string")
    c = spark.createDataFrame([(1, 0, "SELECT 1 FROM car", True, True, True),
                               (2, 0, "SELECT 1 FROM car", True, True, True)], CAND_SCHEMA)
    sel = select_candidates(qs, c)
    reasons = {r.drop_reason: r.n for r in drop_reasons(sel).collect()}
    assert reasons == {"api-RateLimitError": 1}
    f = candidate_funnel(sel, c).first()
    assert (f.examples_kept, f.candidates_total) == (1, 1)


def test_length_filter_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a" * 40,), ("b" * 4,), ("",)], "text string")
    f = DS.length_filter(df, F.col("text"), max_tokens=2)
    assert [r.n_tokens for r in f.collect()] == [10, 1, 0]
    r = DS.length_filter_counts(f).first()
    assert (r.kept, r.dropped) == (2, 1)


@pytest.mark.parametrize("ids", [list(range(500)), [7] * 200 + list(range(50)), [None] * 30 + [3] * 40, [-5, 5, 0, 2 ** 62, -2 ** 62], [1], []])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.4, 0.77, 1.0])
def test_flag_first_takes_exactly_k_in_key_order(spark, ids, share):
    from textsql.operators.ranking import flag_first, integer_key, seeded_key

    df = spark.createDataFrame([(i, str(j)) for j, i in enumerate(ids)], "id long, payload string").repartition(3)
    for key in (integer_key("id"), seeded_key("id", 3)):
        out = flag_first(df.withColumn("key", key), F.col("key"), lambda n: int(round(share * n)), "first").collect()
        assert sorted(int(r.payload) for r in out) == list(range(len(ids)))
        first, rest = ([r.key or "" for r in out if r["first"] is f] for f in (True, False))
        assert len(first) == int(round(share * len(ids)))
        assert not first or not rest or max(first) <= min(rest)


def test_shares_sort_no_payload(spark):
    df = spark.range(1000).selectExpr("id AS question_id", "repeat('text', 50) AS text")
    for out in (DS.assign_modes(df), DS.train_val_split(df), DS.train_val_split(df, head=True), DS.direct_only(DS.assign_modes(df))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan
