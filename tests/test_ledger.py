"""Ledger operators against brute force in Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from textsql.operators import ledger as LG
from textsql.operators.ranking import exact_rank


def calls(spark, n=400, seed=3):
    rng = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=rng.randrange(0, 4 * 3600)), rng.choice([1, 1, 1, 2, 3]),
             rng.randrange(50, 500), rng.randrange(0, 100)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, ledger long, in_tokens long, out_tokens long")


def test_running_spend_matches_sequential(spark):
    rows, df = calls(spark)
    cost = LG.call_cost("in_tokens", "out_tokens")
    got = {r.event_id: r.spend_before for r in LG.running_spend(df, cost).collect()}
    want, acc = {}, {}
    for i, ts, led, a, b in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        want[i] = acc.get(led, 0.0)
        acc[led] = acc.get(led, 0.0) + a * 0.15 / 1e6 + b * 0.60 / 1e6
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_budget_gate_and_spend(spark):
    rows, df = calls(spark, n=50)
    cost = LG.call_cost("in_tokens", "out_tokens")
    gate = LG.budget_gate(LG.running_spend(df, cost), LG.call_cost("in_tokens", F.lit(256)), 0.001)
    got = {r.event_id: r for r in gate.collect()}
    spent, stopped = {}, set()
    for i, ts, led, a, b in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if spent.get(led, 0.0) + a * 0.15 / 1e6 + 256 * 0.6 / 1e6 > 0.001:
            stopped.add(led)
        assert got[i].allowed == (led not in stopped)
        assert abs(got[i].spend_before - spent.get(led, 0.0)) < 1e-12
        if led not in stopped:  # a refused call charges nothing
            spent[led] = spent.get(led, 0.0) + a * 0.15 / 1e6 + b * 0.60 / 1e6
    assert len(got) == len(rows) and stopped
    s = {r.ledger: r for r in LG.spend_summary(df, cost, 0.001).collect()}
    for led, r in s.items():
        assert r.remaining_usd == max(0.0, 0.001 - r.spend_usd)


def test_latency_summary_cold_first(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, base, "m", 3.0, 10, 4), (2, base + dt.timedelta(seconds=5), "m", 1.0, 10, 20),
         (3, base + dt.timedelta(seconds=9), "m", 1.0, 10, 30)],
        "event_id long, ts timestamp, model string, seconds double, in_tokens long, out_tokens long")
    r = LG.latency_summary(df).first()
    assert (r.n_warm, r.cold_load_s, r.cold_first_query_s, r.warm_s_per_query, r.tokens_per_s) == (2, None, 3.0, 1.0, 25.0)
    assert (r.avg_in_tokens, r.avg_out_tokens) == (10, 25)
    loads = spark.createDataFrame([("m", 1.125)], "model string, load_s double")
    r = LG.latency_summary(df, loads=loads, n_warm=1).first()
    assert (r.n_warm, r.cold_load_s, r.tokens_per_s, r.avg_out_tokens) == (1, 1.12, 20.0, 20)  # 1.125 rounds to the even digit
    r = LG.latency_summary(df.limit(0).unionByName(df.where("event_id = 1"))).first()
    assert (r.n_warm, r.warm_s_per_query, r.tokens_per_s) == (0, 0.0, 0.0)


def test_exact_rank_with_hot_key(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(300)]  # two thirds share one value
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    got = {r.id: r.rank for r in exact_rank(df, [F.col("v"), F.col("id")]).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_request_key_stable_and_field_sensitive(spark):
    df = spark.createDataFrame([("m", "sys\nq", 256, 0)], "model string, msg string, mt long, si long")
    k = lambda **kw: df.select(LG.request_key(kw.get("model", "model"), "msg", kw.get("t", 0.3),
                                              kw.get("mt", "mt"), kw.get("si", "si"))).first()[0]
    base = k()
    assert base == k() and len(base) == 64
    assert k(t=0.30001) == base          # temperature is keyed at 4 decimals
    assert k(t=0.31) != base
    assert k(si=F.lit(1)) != base and k(mt=F.lit(512)) != base and k(model=F.lit("other")) != base
