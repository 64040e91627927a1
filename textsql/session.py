"""Session helpers: a tuned local session for tests/bench and the shared lineage-cut folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job in this package is written for. AQE re-plans joins at runtime (broadcast
# when a side turns out small, splits skewed shuffle partitions); coalescing keeps small stages cheap.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "textsql") -> SparkSession:
    """Local session for tests and the bench (UI off; no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TEXTSQL_DRIVER_MEMORY", "8g"))
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared filesystem every executor sees); unset
    there, this raises. Only on a local master do we create one under the local temp folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="textsql-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet to the shared folder and read back: for wide text rows, which a checkpoint
    keeps uncompressed, and for readers that need a few columns each."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Use every core for CPU-heavy per-row work on inputs with few splits.

    Only when the scan yields fewer partitions than the cluster's default parallelism (small
    files, few row groups) is the input round-robin repartitioned; at scale the scan already
    has far more splits than cores and the plan is left untouched (no shuffle of the text).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target * factor)
    return df


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """Tasks of at most about ``rows`` rows for long per-row work, so that the longest task does not grow with
    the input. ``df`` should be narrow and cheap to count (a scan: from the file footers)."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def maybe_broadcast(df: DataFrame, max_rows: int = 100_000, row_bytes: int = 64,
                    max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Broadcast ``df`` only after a count proves it small (rows, and rows x estimated width
    under ``max_bytes``); otherwise leave the shuffle join, where AQE still splits skewed
    partitions. Meant for sides that are cheap to count (derived from questions, statement
    lists, hand-written tables), never for a data-sized side."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows and n * row_bytes <= max_bytes else df
