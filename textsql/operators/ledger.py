"""Requests, response store and spend.

The response store is a table keyed by request hash, partitioned by the key's first two hex
characters (A9); a replay is a left join of requests to it (J9), misses are the anti join.
Spend is an append-only ledger; running spend per ledger is a range-partitioned two-level
prefix sum, so one busy ledger never becomes one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col_
from ..session import cut_lineage, maybe_broadcast
from .ranking import running_sum

# --- fixed values -----------------------------------------------------------------------------
PRICE_INPUT_PER_M = 0.15
PRICE_OUTPUT_PER_M = 0.60
KEY_SEPARATOR = "\x1f"
ESTIMATE_LOW, ESTIMATE_HIGH = 0.7, 1.4
# ----------------------------------------------------------------------------------------------


def request_key(model: Column | str, messages_text: Column | str, temperature: float,
                max_tokens: Column | str | int, sample_index: Column | str | int) -> Column:
    """P20: SHA-256 over the request fields in a fixed order (temperature at 4 dp).

    Its own key space: stable across runs and reproducible in any SQL engine."""
    def c(x):
        return F.lit(x) if isinstance(x, int) else col_(x)
    return F.sha2(F.concat_ws(KEY_SEPARATOR, F.coalesce(col_(model), F.lit("")),
                              F.coalesce(col_(messages_text), F.lit("")), F.lit(f"{temperature:.4f}"),
                              c(max_tokens).cast("string"), c(sample_index).cast("string")), 256)


def call_cost(in_tokens: Column | str, out_tokens: Column | str,
              price_in: float = PRICE_INPUT_PER_M, price_out: float = PRICE_OUTPUT_PER_M) -> Column:
    """Dollars for one call."""
    return col_(in_tokens) * (price_in / 1_000_000) + col_(out_tokens) * (price_out / 1_000_000)


def replay(requests: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Every request with its stored response; ``cached`` marks a hit, a miss has an empty
    response text and zero tokens. A key that was stored again counts once: its last row by
    ``saved_at`` where the store has it, else its greatest row."""
    row = F.struct(*(["saved_at"] if "saved_at" in store.columns else []), "text", "prompt_tokens", "completion_tokens")
    s = store.groupBy(key).agg(F.max(row).alias("__r")).select(
        key, "__r.text", "__r.prompt_tokens", "__r.completion_tokens", F.lit(True).alias("cached"))
    return requests.join(s, on=key, how="left").select(
        "*",
    ).withColumns({
        "cached": F.coalesce(F.col("cached"), F.lit(False)),
        "text": F.coalesce(F.col("text"), F.lit("")),
        "prompt_tokens": F.coalesce(F.col("prompt_tokens"), F.lit(0)),
        "completion_tokens": F.coalesce(F.col("completion_tokens"), F.lit(0)),
    })


def misses(requests: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Requests that still need work."""
    return requests.join(store.select(key), on=key, how="left_anti")


def write_store(responses: DataFrame, path: str, key: str = "key") -> None:
    """A9 as plain files: responses in folders by the key's two-character prefix. The folders that a write
    touches are replaced by what they held merged with the new rows, one row per key (the last by
    ``saved_at`` where there is one, else the greatest), so a repeated write changes nothing.
    ``sources.store`` keeps the same store as a bucketed table for replays without a shuffle of it."""
    spark = responses.sparkSession
    rows = cut_lineage(responses.where(F.col(key).isNotNull()).withColumn("key_prefix", F.substring(key, 1, 2)))
    touched = [r[0] for r in rows.select("key_prefix").distinct().collect()]  # at most 16^2 for hex keys
    if not touched:
        return
    try:
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("key_prefix").isin(touched))
    except AnalysisException:  # the first write
        old = rows.limit(0)
    first = ["saved_at"] if "saved_at" in rows.columns else []
    rest = [c for c in rows.columns if c not in (key, "key_prefix", *first)]
    merged = old.unionByName(rows).groupBy(key, "key_prefix").agg(F.max(F.struct(*first, *rest)).alias("__r")).select(
        *[c if c in (key, "key_prefix") else F.col(f"__r.{c}") for c in rows.columns])
    cut_lineage(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_prefix").parquet(path)


def replay_counts(replayed: DataFrame) -> DataFrame:
    """Calls, hits and misses."""
    return replayed.agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("hits"),
                        F.count_if(~F.col("cached")).alias("misses"))


def running_spend(calls: DataFrame, cost: Column, ledger_col: str = "ledger", ts_col: str = "ts",
                  id_col: str = "event_id") -> DataFrame:
    """Spend of all earlier calls of the same ledger (order ts, id), as ``spend_before``;
    adds ``cost``. A skew-proof exclusive prefix sum (``ranking.running_sum``): one busy ledger
    is cut into ranges, never one window partition."""
    c = calls.withColumn("cost", cost)
    return running_sum(c, [ledger_col], [ts_col, id_col], F.col("cost"), out_col="spend_before")


def budget_gate(spent: DataFrame, estimate: Column, cap_usd: float, ledger_col: str = "ledger", ts_col: str = "ts",
                id_col: str = "event_id") -> DataFrame:
    """F8: a ledger stops at its first call whose upper-bound estimate on top of the spend so far
    exceeds the cap. That call and all later ones are refused and charge nothing, so
    ``spend_before`` stays at what the admitted calls have spent. The stop is one pre-aggregated
    row per ledger."""
    at = F.struct(F.col(ts_col), F.col(id_col))
    stop = spent.where(F.col("spend_before") + estimate > F.lit(cap_usd)).groupBy(F.col(ledger_col).alias("__ledger")).agg(
        F.min(at).alias("__stop"), F.min_by("spend_before", at).alias("__spent"))
    out = spent.join(stop, F.col(ledger_col).eqNullSafe(F.col("__ledger")), "left")
    allowed = F.col("__stop").isNull() | (at < F.col("__stop"))
    return out.withColumn("allowed", allowed).withColumn(
        "spend_before", F.when(F.col("allowed"), F.col("spend_before")).otherwise(F.col("__spent"))).drop(
        "__ledger", "__stop", "__spent")


def spend_summary(calls: DataFrame, cost: Column, cap_usd: float, ledger_col: str = "ledger") -> DataFrame:
    """Total spend per ledger and remaining = max(0, cap - spend)."""
    return calls.groupBy(ledger_col).agg(F.sum(cost).alias("spend_usd")).withColumn(
        "remaining_usd", F.greatest(F.lit(0.0), F.lit(cap_usd) - F.col("spend_usd")))


def latency_summary(timings: DataFrame, group_col: str = "model", ts_col: str = "ts", id_col: str = "event_id",
                    seconds_col: str = "seconds", in_col: str = "in_tokens", out_col: str = "out_tokens",
                    loads: DataFrame | None = None, n_warm: int | None = None) -> DataFrame:
    """First call per group is cold, the rest (or the ``n_warm`` calls after it) warm; tokens/s and the
    token averages are over warm calls. ``loads`` (group, load_s) gives the load time apart from the first
    query's. Figures are rounded half to even. ``min_by`` finds the cold row as a partial aggregate (no
    window); only ``n_warm`` ranks calls, by a group-limited window."""
    if n_warm is not None:
        w = Window.partitionBy(group_col).orderBy(ts_col, id_col)
        timings = timings.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n_warm + 1).drop("__r")
    order = F.struct(F.col(ts_col), F.col(id_col))
    g = timings.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(seconds_col, in_col, out_col), order).alias("__cold"),
        F.sum(seconds_col).alias("__s"), F.sum(in_col).alias("__i"), F.sum(out_col).alias("__o"),
    )
    if loads is not None:
        g = g.join(maybe_broadcast(loads.select(group_col, "load_s"), max_rows=10_000), group_col, "left")
    else:
        g = g.withColumn("load_s", F.lit(None).cast("double"))
    warm = F.col("n") - 1
    warm_s, warm_i, warm_o = (F.col(c) - F.col("__cold")[col] for c, col in (("__s", seconds_col), ("__i", in_col), ("__o", out_col)))
    per = lambda x: F.coalesce(F.when(warm > 0, x / warm), F.lit(0.0))
    return g.select(
        group_col,
        warm.alias("n_warm"),
        F.bround("load_s", 2).alias("cold_load_s"),
        F.bround(F.col("__cold")[seconds_col], 3).alias("cold_first_query_s"),
        F.bround(per(warm_s), 3).alias("warm_s_per_query"),
        F.bround(warm_o / F.greatest(warm_s, F.lit(1e-3)), 1).alias("tokens_per_s"),
        F.bround(per(warm_i), 0).alias("avg_in_tokens"),
        F.bround(per(warm_o), 0).alias("avg_out_tokens"),
    )


def cost_per_1k(replayed: DataFrame, group_col: str = "model") -> DataFrame:
    """Average tokens over cache hits and dollars per 1,000 queries; no hits -> no row."""
    hits = replayed.filter("cached")
    return hits.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("hits"),
        F.avg("prompt_tokens").alias("avg_in_tokens"),
        F.avg("completion_tokens").alias("avg_out_tokens"),
    ).withColumn("usd_per_1k", 1000 * call_cost("avg_in_tokens", "avg_out_tokens"))


def estimate_range(requests: DataFrame, in_col: str, max_out_col: str) -> DataFrame:
    """P22 pre-run estimate: upper bound of all calls and the (0.7x, 1.4x) range."""
    ub = requests.agg(F.sum(call_cost(in_col, max_out_col)).alias("estimate_usd"))
    return ub.select("estimate_usd", (F.col("estimate_usd") * ESTIMATE_LOW).alias("low_usd"),
                     (F.col("estimate_usd") * ESTIMATE_HIGH).alias("high_usd"))


def append_ledger(calls: DataFrame, cost: Column, path: str, run_id: str) -> None:
    """A10 write side: store this run's priced calls (unrounded: a call of a few tokens costs less than a
    millionth) to the shared ledger table, partitioned by run so a retried run replaces only itself."""
    (calls.withColumn("cost_usd", cost).withColumn("run_id", F.lit(run_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def load_spend(spark, path: str, cap_usd: float, ledger_col: str = "ledger") -> DataFrame:
    """A10 read side: cumulative spend over all recorded runs and what remains under the cap, both rounded
    once, as totals (6 dp)."""
    led = spark.read.parquet(path)
    return spend_summary(led, F.col("cost_usd"), cap_usd, ledger_col).withColumns(
        {c: F.bround(c, 6) for c in ("spend_usd", "remaining_usd")})


def complete_with(requests: DataFrame, fn, key: str = "key", text_col: str = "messages_text") -> DataFrame:
    """U2 completion hook: ``fn(pandas.DataFrame) -> pandas.DataFrame`` with columns ``text``,
    ``prompt_tokens``, ``completion_tokens`` (one row per request, same order), run per Arrow
    batch on the executors via ``mapInPandas``. Typical use: ``complete_with(misses(req, store),
    client)`` and then ``write_store`` -- only cache misses ever reach the model."""

    def _run(batches):
        for pdf in batches:
            out = fn(pdf[[key, text_col]])
            yield pdf[[key]].assign(text=out["text"].astype(str).values,
                                    prompt_tokens=out["prompt_tokens"].astype("int64").values,
                                    completion_tokens=out["completion_tokens"].astype("int64").values)

    return requests.select(key, text_col).mapInPandas(
        _run, "key string, text string, prompt_tokens long, completion_tokens long")
