"""Structured Streaming variants (R1, R2): traces and counters from responses still landing.

Landing files are JSON lines ``(key, text, prompt_tokens, completion_tokens, saved_at)``.
Files land in any order, so no watermark applies and no row is too late: a key counts once however
late it comes again. The keys seen so far are the stream's state, kept by Spark's RocksDB state store (on the
executors' disks, not in their heaps) with changelog checkpoints in the shared checkpoint folder. An
epoch therefore looks up and stores its own keys only; what earlier epochs wrote is never read
again. Each epoch is written as one parquet partition with overwrite, so a replayed epoch rewrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from ..functions.prompts import extract_sql, split_reasoning
from ..session import scratch_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

LANDING_SCHEMA = StructType([
    StructField("key", StringType(), False),
    StructField("text", StringType(), True),
    StructField("prompt_tokens", LongType(), True),
    StructField("completion_tokens", LongType(), True),
    StructField("saved_at", TimestampType(), True),
])


def landing_stream(spark: SparkSession, path: str, files_per_trigger: int = 2) -> DataFrame:
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _open_sink(rows: DataFrame, sink: str) -> None:
    """An empty epoch gives the sink its schema before the first micro-batch."""
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{sink}/epoch=-1")


def new_keys(landing: DataFrame) -> DataFrame:
    """The first landing of every key, by stream state."""
    return landing.dropDuplicates(["key"])


def _run(rows: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Run a stream to the end of what has landed. The state store's settings hold for this stream: a
    query takes them over when it starts."""
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            conf.set(k, v)
        q = (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    q.awaitTermination()
    return q


def trace_rows(responses: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per response: extracted SQL and reasoning (P10/P11); with ``requests`` (key, question_id,
    ...) a stream-static join attaches the request side."""
    out = responses.select("key", extract_sql("text").alias("sql"), split_reasoning("text").alias("reasoning"),
                           "prompt_tokens", "completion_tokens", "saved_at")
    if requests is not None:
        out = out.join(requests, on="key", how="left")
    return out


def build_traces_stream(spark: SparkSession, landing: str, sink: str, requests: DataFrame | None = None,
                        checkpoint: str | None = None, files_per_trigger: int = 2) -> DataFrame:
    """Run the stream to completion over what has landed (``availableNow``) and return the
    sink as a batch DataFrame (one row per key)."""
    rows = trace_rows(new_keys(landing_stream(spark, landing, files_per_trigger)), requests)
    _open_sink(rows, sink)
    _run(rows, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}"),
         checkpoint or scratch_path(spark, "r1-ckpt"))
    return spark.read.parquet(sink)


def counters_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str | None = None,
                    files_per_trigger: int = 2) -> DataFrame:
    """R2: live kept / dropped counters (a response is kept when SQL can be extracted) and
    token totals. Each epoch adds the sums of its new keys, two rows at most, and the counters are
    the sums over the epochs."""
    rows = new_keys(landing_stream(spark, landing, files_per_trigger)).select(
        F.when(extract_sql("text").isNull(), "dropped").otherwise("kept").alias("outcome"),
        "prompt_tokens", "completion_tokens")
    sums = lambda df, n: df.groupBy("outcome").agg(
        n.alias("n"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    one = F.count(F.lit(1))
    _open_sink(sums(spark.createDataFrame([], rows.schema), one), sink)
    _run(rows, lambda batch, epoch: sums(batch, one).coalesce(1).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}"),
         checkpoint or scratch_path(spark, "r2-ckpt"))
    return sums(spark.read.parquet(sink), F.sum("n"))


def write_landing(responses: DataFrame, path: str, n_files: int = 4) -> None:
    """Test/bench helper: drop responses into the landing folder as ``n_files`` JSON files."""
    responses.select(*[f.name for f in LANDING_SCHEMA.fields]).repartition(n_files, "key").write.mode(
        "overwrite").json(path)
