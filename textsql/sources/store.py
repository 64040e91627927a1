"""The response store as a bucketed table (A9, J9): upserts of touched prefixes, replay without moving the store.

One row per request key. Rows lie in one folder per key prefix, and in each in files bucketed by the key. A write
replaces the folders of the prefixes it touches (dynamic partition overwrite) by what they held merged with the
new responses, the later ``saved_at`` winning, so a write that is repeated changes nothing. A replay joins
requests to buckets: only the requests are shuffled, the store is read where it lies.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

COLUMNS = ("key", "text", "prompt_tokens", "completion_tokens", "saved_at")


@contextmanager
def _conf(spark: SparkSession, **settings: str):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def open_store(spark: SparkSession, name: str, path: str, buckets: int = 64, prefix_chars: int = 2) -> DataFrame:
    """Register (and if new create) the store at ``path`` as table ``name``. A store's number of buckets and
    of prefix characters stay what they were when it was created."""
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (key STRING, text STRING, prompt_tokens BIGINT, completion_tokens BIGINT,
        saved_at TIMESTAMP, key_prefix STRING) USING parquet PARTITIONED BY (key_prefix)
        CLUSTERED BY (key) INTO {int(buckets)} BUCKETS LOCATION '{path}'
        TBLPROPERTIES ('textsql.buckets' = '{int(buckets)}', 'textsql.prefix' = '{int(prefix_chars)}')""")
    try:
        spark.read.schema("key string").parquet(path)
    except AnalysisException:
        return spark.table(name)  # nothing is written there yet
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")  # folders that other sessions have written
    return spark.table(name)


def _property(spark: SparkSession, name: str, key: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {name} ('textsql.{key}')").first()["value"])


def upsert_responses(spark: SparkSession, name: str, responses: DataFrame) -> None:
    """Write responses (key, text, prompt_tokens, completion_tokens, saved_at); a null saved_at is the
    earliest. Rows without a key are refused. Of a key's rows the one saved last stays, of equal times the
    greatest row."""
    buckets, chars = _property(spark, name, "buckets"), _property(spark, name, "prefix")
    rows = responses.select(F.col("key"), F.col("text"), F.col("prompt_tokens").cast("long"),
                            F.col("completion_tokens").cast("long"), F.col("saved_at").cast("timestamp"))
    rows = cut_lineage(rows.where(F.when(F.col("key").isNull(), F.raise_error(F.lit("response without a key"))).otherwise(F.lit(True))))
    # at most 16^chars values for hex keys
    touched = [r[0] for r in rows.select(F.substring("key", 1, chars)).distinct().collect()]
    if not touched:
        return
    old = spark.table(name).where(F.col("key_prefix").isin(touched)).select(*COLUMNS)
    best = F.max(F.struct("saved_at", "text", "prompt_tokens", "completion_tokens")).alias("r")
    merged = old.unionByName(rows).groupBy("key").agg(best).select(
        "key", "r.text", "r.prompt_tokens", "r.completion_tokens", "r.saved_at", F.substring("key", 1, chars).alias("key_prefix"))
    merged = cut_lineage(merged.repartition(buckets, "key"))  # the folders are replaced while they'd be read
    with _conf(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        merged.write.mode("overwrite").insertInto(name)


def replay_store(spark: SparkSession, requests: DataFrame, name: str, key: str = "key") -> DataFrame:
    """J9 over the store: every request with its response; ``cached`` marks a hit, a miss has an empty text
    and zero tokens. The requests are dealt by the store's own buckets, so the store isn't shuffled."""
    store = spark.table(name).select(F.col("key").alias(key), "text", "prompt_tokens", "completion_tokens",
                                     F.lit(True).alias("cached"))
    out = requests.repartition(_property(spark, name, "buckets"), key).join(store.hint("shuffle_merge"), key, "left")
    return out.withColumns({
        "cached": F.coalesce(F.col("cached"), F.lit(False)), "text": F.coalesce(F.col("text"), F.lit("")),
        "prompt_tokens": F.coalesce(F.col("prompt_tokens"), F.lit(0)),
        "completion_tokens": F.coalesce(F.col("completion_tokens"), F.lit(0))})


def missing_requests(spark: SparkSession, requests: DataFrame, name: str, key: str = "key") -> DataFrame:
    """Requests that the store can't answer yet; only those reach a model."""
    store = spark.table(name).select(F.col("key").alias(key))
    return requests.repartition(_property(spark, name, "buckets"), key).join(store.hint("shuffle_merge"), key, "left_anti")
